"""Fixed values that matching rules look up: keywords, ranks, aliases, patterns. Data, not logic."""

PLACEHOLDERS = ("company pending", "role pending", "project pending", "school pending", "skill pending", "tag pending", "language pending", "resume summary pending.", "job description pending.", "untitled role", "optional skills", "experience pending")
CONTACT_LABELS = ("联系方式", "社交主页", "联系电话", "手机号", "电话", "邮箱", "微信", "wechat", "qq", "mail", "email")

LEVEL_RANK = {"basic": 1, "intermediate": 2, "advanced": 3, "expert": 4}
DEGREE_RANK = {"high_school": 1, "高中": 1, "college": 2, "associate": 2, "大专": 2, "专科": 2, "bachelor": 3, "本科": 3, "学士": 3, "master": 4, "mba": 4, "硕士": 4, "研究生": 4, "phd": 5, "doctor": 5, "博士": 5}
BACHELOR = 3

ROLE_KEYWORDS = {
    "hardware_engineer": ("hardware", "硬件", "electrical", "电子", "射频", "rf", "pcb", "电气"),
    "embedded_engineer": ("embedded", "嵌入式", "firmware", "bsp", "rtos", "单片机", "驱动"),
    "frontend_engineer": ("frontend", "front-end", "前端", "web前端", "h5开发"),
    "backend_engineer": ("backend", "back-end", "后端", "server", "服务端"),
    "fullstack_engineer": ("full stack", "fullstack", "全栈"),
    "testing_engineer": ("test", "testing", "qa", "质量", "测试", "验证"),
    "algorithm_engineer": ("algorithm", "ml", "machine learning", "ai", "llm", "算法", "机器学习", "深度学习"),
    "data_engineer": ("data", "big data", "database", "etl", "大数据", "数据工程", "数仓"),
    "devops_engineer": ("devops", "sre", "infra", "platform", "运维", "基础设施"),
    "mobile_engineer": ("android", "ios", "mobile", "flutter", "react native", "移动开发"),
    "product_manager": ("product manager", "pm", "产品经理"),
    "uiux_designer": ("ux", "ui", "designer", "design", "交互设计", "视觉设计", "设计师"),
}
RESUME_ROLE_KEYWORDS = {
    "frontend_engineer": ("前端", "frontend", "react", "vue", "javascript", "typescript", "web前端"),
    "backend_engineer": ("后端", "backend", "server", "php", "laravel", "python", "java", "spring", "golang", "go语言"),
    "fullstack_engineer": ("全栈", "full stack", "fullstack"),
    "algorithm_engineer": ("算法", "algorithm", "机器学习", "machine learning", "深度学习", "llm", "大模型", "nlp", "cv"),
    "data_engineer": ("数据", "data", "etl", "数仓", "大数据"),
    "mobile_engineer": ("android", "ios", "flutter", "uniapp", "react native", "小程序", "app"),
    "testing_engineer": ("测试", "qa", "test", "testing"),
}
MODE_KEYWORDS = {
    "remote": ("remote", "work from home", "wfh", "home office", "远程", "居家办公"),
    "hybrid": ("hybrid", "混合办公", "弹性办公"),
    "onsite": ("onsite", "on-site", "in office", "线下", "坐班", "驻场", "现场"),
}
RESUME_MODE_KEYWORDS = {"remote": ("remote", "wfh", "work from home", "远程", "居家办公"), "hybrid": ("hybrid", "混合办公", "弹性办公")}
AI_KEYWORDS = {
    "llm": ("llm", "大模型", "foundation model"),
    "rag": ("rag", "retrieval augmented generation"),
    "agent": ("agent", "智能体", "ai agent"),
    "prompt": ("prompt", "prompt engineering", "prompt design"),
    "ai_infra": ("ai infra", "model serving", "inference platform", "mcp"),
}
RESUME_AI_KEYWORDS = ("llm", "rag", "agent", "ai infra", "prompt", "大模型", "智能体", "mcp")
INTERN_KEYWORDS = ("intern", "实习")
JOB_ENTRY_WORDS = ("intern", "campus", "graduate", "实习", "校招", "应届")
JOB_SENIOR_WORDS = ("senior", "lead", "architect", "principal", "staff")
RESUME_LEAD_KEYWORDS = ("architect", "tech lead", "team lead", "leader", "技术负责人", "负责人", "架构师", "架构")
MAJOR_CITIES = ("北京", "上海", "深圳", "广州", "杭州")
ENTRY_ROLE_KEYWORDS = ("junior", "entry", "entry-level", "associate", "trainee", "intern", "实习", "校招", "应届", "毕业生", "初级")
SENIOR_ROLE_KEYWORDS = ("senior", "staff", "principal", "expert", "lead", "architect", "高级", "资深", "专家", "架构师")
SPECIALIZED_KEYWORDS = ("高级", "专家", "核心自研", "大模型", "银行", "保险", "交易", "稳定性", "高并发", "分布式", "云原生", "平台方向")
LEAD_KEYWORDS = ("主管", "主程", "经理", "总监", "负责人", "leader", "架构师")
CAMPUS_PATTERN = r"(?i)20\d{2}\s*届|\bcampus\b|\bgraduate\b|校招|应届|毕业生"
GENERIC_PATTERNS = ("前端，后端，测试岗位均有", "前端、后端，测试岗位均有", "前端/后端/测试", "前后端开发?测试", "前端后端测试", "多方向", "均有")
TITLE_SKILL_PATTERNS = {
    "java": ("java",), "python": ("python",), "go": ("golang", "go", "go语言"), "php": ("php",), "c++": ("c++", "cpp"), "c#": ("c#", "csharp", ".net", "dotnet"),
    "javascript": ("javascript", "js", "前端"), "typescript": ("typescript", "ts"), "react": ("react",), "vue": ("vue",), "flutter": ("flutter",), "android": ("android",),
    "ios": ("ios", "swift", "objective-c"), "kotlin": ("kotlin",), "llm": ("llm", "大模型", "ai", "人工智能"),
}
BRIDGES = {
    "go": {"php": 0.72, "laravel": 0.74, "python": 0.58, "java": 0.60, "mysql": 0.18, "redis": 0.18},
    "python": {"php": 0.68, "laravel": 0.70, "java": 0.35, "go": 0.52, "mysql": 0.20, "redis": 0.20},
    "java": {"php": 0.42, "laravel": 0.44, "python": 0.35, "go": 0.55, "mysql": 0.18, "redis": 0.18},
    "php": {"python": 0.62, "go": 0.58, "java": 0.40, "mysql": 0.22, "redis": 0.22},
    "react": {"vue": 0.90, "javascript": 0.92, "typescript": 0.94, "uniapp": 0.58, "flutter": 0.38},
    "vue": {"react": 0.88, "javascript": 0.92, "typescript": 0.94, "uniapp": 0.74, "flutter": 0.36},
    "flutter": {"uniapp": 0.70, "android": 0.58, "ios": 0.52, "react": 0.42, "vue": 0.34},
    "javascript": {"typescript": 0.96, "vue": 0.92, "react": 0.92},
    "typescript": {"javascript": 0.96, "vue": 0.92, "react": 0.92},
}
BACKEND_TARGETS = ("go", "python", "php", "java")
FRONTEND_TARGETS = ("react", "vue", "javascript", "typescript")
CITY_REGIONS = (("上海", "杭州", "苏州", "南京", "无锡", "宁波", "嘉兴", "绍兴", "湖州", "常州", "昆山"), ("北京", "天津", "石家庄", "廊坊"), ("深圳", "广州", "东莞", "佛山", "珠海", "惠州"))
CLOSE_CITIES = (("上海", "杭州"), ("上海", "苏州"), ("上海", "昆山"), ("深圳", "广州"), ("深圳", "东莞"), ("广州", "佛山"), ("北京", "天津"), ("杭州", "宁波"), ("南京", "苏州"))

FRONTEND_FRAMEWORKS = ("vue", "react", "angular", "next.js", "nuxt.js", "svelte")
FRONTEND_SIGNALS = FRONTEND_FRAMEWORKS + ("javascript", "typescript", "html", "css", "vite", "webpack", "pinia", "vue router", "element-ui", "tailwindcss", "echarts", "uniapp")
BACKEND_SIGNALS = ("java", "spring", "spring boot", "python", "django", "flask", "fastapi", "php", "laravel", "go", "mysql", "postgresql", "redis")
MOBILE_SIGNALS = ("android", "ios", "flutter", "react native", "swift", "objective-c", "kotlin", "uniapp")
GIT_PLATFORMS = ("gitee", "github", "gitlab")

#: Skills found in text: name, then patterns; a name alone is its own lower-case word.
SKILL_PATTERNS = [
    ("Python", (r"\bpython\b",)), ("Java", (r"\bjava\b",)), ("Golang", (r"\bgolang\b",)), ("C++", (r"\bc\+\+\b",)), ("C#", (r"\bc#\b", r"\bcsharp\b")), ("JavaScript", (r"\bjavascript\b",)),
    ("TypeScript", (r"\btypescript\b",)), ("Node.js", (r"\bnode\.?js\b",)), ("React", (r"\breact\b",)), ("Vue", (r"\bvue(?:\.js)?\b",)), ("Angular", (r"\bangular\b",)), ("HTML5", (r"\bhtml5\b",)),
    ("CSS3", (r"\bcss3\b",)), ("Flask", (r"\bflask\b",)), ("FastAPI", (r"\bfastapi\b",)), ("Django", (r"\bdjango\b",)), ("Spring", (r"\bspring\b",)), ("Spring Boot", (r"\bspring\s*boot\b",)),
    ("MySQL", (r"\bmysql\b",)), ("PostgreSQL", (r"\bpostgres(?:ql)?\b",)), ("Redis", (r"\bredis\b",)), ("MongoDB", (r"\bmongodb\b",)), ("Oracle", (r"\boracle\b",)), ("SQL", (r"\bsql\b",)),
    ("Kafka", (r"\bkafka\b",)), ("RabbitMQ", (r"\brabbitmq\b",)), ("Elasticsearch", (r"\belasticsearch\b",)), ("Docker", (r"\bdocker\b",)), ("Kubernetes", (r"\bkubernetes\b", r"\bk8s\b")), ("Linux", (r"\blinux\b",)),
    ("Git", (r"\bgit\b",)), ("Jenkins", (r"\bjenkins\b",)), ("AWS", (r"\baws\b",)), ("Azure", (r"\bazure\b",)), ("GCP", (r"\bgcp\b", r"\bgoogle cloud\b")), ("TensorFlow", (r"\btensorflow\b",)),
    ("PyTorch", (r"\bpytorch\b",)), ("LLM", (r"\bllm\b", r"大模型")), ("Embedding", (r"\bembedding\b",)), ("RAG", (r"\brag\b",)), ("Prompt Design", (r"\bprompt\b", r"提示词")), ("Qdrant", (r"\bqdrant\b",)),
    ("pgvector", (r"\bpgvector\b",)), ("ETL", (r"\betl\b",)), ("Selenium", (r"\bselenium\b",)), ("Appium", (r"\bappium\b",)), ("Playwright", (r"\bplaywright\b",)), ("Cypress", (r"\bcypress\b",)),
    ("JMeter", (r"\bjmeter\b",)), ("LoadRunner", (r"\bloadrunner\b",)), ("自动化测试", (r"自动化测试",)), ("接口测试", (r"接口测试",)), ("功能测试", (r"功能测试",)), ("性能测试", (r"性能测试",)),
    ("白盒测试", (r"白盒测试",)), ("黑盒测试", (r"黑盒测试",)), ("测试开发", (r"测试开发",)), ("数据分析", (r"数据分析",)),
]

#: Canonical skill and its other names, lower case; a later line wins where two claim a name.
SKILL_ALIASES = {
    "javascript": ("js", "ecmascript", "es6", "es2015", "es2016", "es2017", "es2020", "es2021", "es2022"), "typescript": ("ts",), "react": ("react.js", "reactjs", "react js"), "vue": ("vue.js", "vuejs", "vue js", "vue2", "vue3"),
    "angular": ("angular.js", "angularjs", "angular js"), "next.js": ("nextjs", "next js", "next"), "nuxt.js": ("nuxtjs", "nuxt js", "nuxt"), "node.js": ("nodejs", "node js", "node"), "express.js": ("expressjs", "express"), "nest.js": ("nestjs", "nest"),
    "vite": ("vitejs", "vite.js"), "webpack": ("webpackjs",), "jquery": ("jquery.js",), "svelte": ("sveltejs", "svelte.js"), "electron": ("electron.js", "electronjs"), "deno": ("deno.js",), "bun": ("bun.js",), "pinia": ("vuex",),
    "css": ("css3", "cascading style sheets"), "html": ("html5",), "sass": ("scss",), "less": ("less css", "lesscss"), "tailwindcss": ("tailwind", "tailwind css"), "bootstrap": ("bootstrap5", "bootstrap4"), "antd": ("ant design", "ant-design"),
    "element-ui": ("element ui", "elementui", "element-plus", "element plus"), "python": ("python3", "python2", "py"), "django": ("django rest framework", "drf"), "flask": ("flask-restful",), "fastapi": ("fast api",), "pytorch": ("torch",), "tensorflow": ("tf",),
    "pandas": ("pd",), "numpy": ("np",), "scikit-learn": ("sklearn", "scikit learn"), "celery": ("celery task queue",), "java": ("jdk", "jre"), "spring": ("spring framework",), "spring boot": ("springboot", "spring-boot"), "spring cloud": ("springcloud", "spring-cloud"),
    "mybatis": ("mybatis-plus", "mybatisplus"), "go": ("golang", "go lang"), "gin": ("gin framework", "gin-gonic"), "rust": ("rust lang", "rustlang"), "c++": ("cpp", "cplusplus", "c plus plus"), "c#": ("csharp", "c sharp"), "c": ("c language", "c lang"),
    ".net": ("dotnet", "dot net", ".net core", "dotnet core"), "mysql": ("mariadb",), "postgresql": ("postgres", "pg", "pgsql"), "mongodb": ("mongo",), "redis": ("redis cache",), "elasticsearch": ("es", "elastic search", "elastic"), "sqlite": ("sqlite3",),
    "oracle": ("oracle db", "oracledb"), "sql server": ("mssql", "ms sql", "microsoft sql server"), "cassandra": ("apache cassandra",), "neo4j": ("neo4j graph",), "docker": ("docker container",), "kubernetes": ("k8s", "kube"), "aws": ("amazon web services",),
    "gcp": ("google cloud", "google cloud platform"), "azure": ("microsoft azure",), "terraform": ("tf iac",), "ansible": ("ansible playbook",), "jenkins": ("jenkins ci",), "github actions": ("gh actions",), "gitlab ci": ("gitlab-ci", "gitlab ci/cd"), "nginx": ("nginx proxy",),
    "linux": ("gnu/linux",), "ubuntu": ("ubuntu linux",), "centos": ("centos linux",), "kafka": ("apache kafka",), "rabbitmq": ("rabbit mq", "rabbit"), "rocketmq": ("rocket mq",), "react native": ("rn", "react-native"), "flutter": ("flutter sdk",), "swift": ("swift ui", "swiftui"),
    "kotlin": ("kotlin android",), "objective-c": ("objc", "obj-c"), "machine learning": ("ml",), "deep learning": ("dl",), "natural language processing": ("nlp",), "computer vision": ("cv",), "large language model": ("llm", "大语言模型", "大模型"),
    "reinforcement learning": ("rl", "强化学习"), "restful api": ("rest api", "rest", "restful"), "graphql": ("graph ql",), "grpc": ("g-rpc",), "websocket": ("ws", "web socket"), "git": ("git version control",), "svn": ("subversion",), "agile": ("scrum", "敏捷开发"),
    "ci/cd": ("cicd", "ci cd", "持续集成"), "microservices": ("micro services", "微服务", "微服务架构"), "分布式系统": ("distributed systems", "distributed system"),
}

LANGUAGE_PATTERNS = {"英语": ("英语", "英文", "cet-4", "cet4", "cet-6", "cet6", "四级", "六级", "toeic", "toefl", "ielts"), "日语": ("日语", "jlpt", "n1", "n2"), "韩语": ("韩语",), "法语": ("法语",), "德语": ("德语",)}
CERTIFICATIONS = ("PMP", "CPA", "CFA", "软考", "信息系统项目管理师", "教师资格证", "证券从业", "基金从业", "一级建造师", "二级建造师", "注册会计师")
MIN_DEGREE_PATTERNS = {"doctor": "博士及以上|博士研究生|phd|doctor", "master": "硕士及以上|硕士研究生|研究生及以上|master", "bachelor": "本科及以上|本科或以上|本科学历|学士|bachelor|统招本科", "associate": "大专及以上|专科及以上|associate|college", "high_school": "高中及以上|high school"}
PREFER_DEGREE_PATTERNS = {"doctor": "博士(?:学历)?优先|phd.+优先|doctor.+优先", "master": "硕士(?:学历)?优先|研究生优先|master.+优先", "bachelor": "本科(?:学历)?优先|学士优先|bachelor.+优先"}
# What opens the parts of a posting, what ends them, what a headed item may begin with, and words of an item worth showing.
RESPONSIBILITY_MARKERS = ("岗位职责", "工作职责", "职责描述", "职位职责", "工作内容", "你将参与", "职责")
HIGHLIGHT_MARKERS = ("福利待遇", "加分项", "优选条件", "优先条件", "优选项", "加分")
SECTION_ENDS = ("岗位要求", "任职要求", "任职资格", "职位要求", "我们希望你", "岗位核心方向补充", "福利待遇", "加分项", "优选条件", "优先条件", "其他要求")
ITEM_HEADINGS = ("岗位职责", "工作职责", "职责描述", "职位职责", "工作内容", "岗位要求", "任职要求", "任职资格", "职位要求", "福利待遇", "加分项", "优选条件", "优先条件", "优选项", "其他要求")
HIGHLIGHT_KEYWORDS = ("优先", "加分", "优选", "福利", "待遇", "可转正", "弹性", "双休", "六险一金", "期权", "奖金", "补贴", "餐补", "房补", "落户", "班车", "商业保险")
EDUCATION_WORDS = ("本科", "硕士", "博士", "研究生", "学历", "专业")
# Skills and words that tell what kind of work a piece of experience was.
STACKS = {"前端": ("vue", "react", "javascript", "typescript", "uniapp", "html", "css"), "后端": ("php", "laravel", "java", "python", "golang", "node.js", "mysql", "postgresql"), "移动端": ("flutter", "android", "ios", "uniapp", "react native")}
STACK_WORDS = {"前端": ("前端", "h5", "小程序", "web"), "后端": ("后端", "接口", "服务端", "管理后台"), "移动端": ("app", "客户端", "移动端")}
MAJOR_STOPWORDS = ("相关专业", "专业", "等", "以及", "及", "或", "优先", "者优先", "岗位要求", "任职要求", "任职资格", "职位要求", "我们希望你", "具备", "本科", "硕士", "博士", "学历", "海内外", "统招")
OTHER_CONSTRAINT_WORDS = ("每周", "到岗", "连续", "出差", "轮班", "驻场", "现场", "实习4", "实习5", "实习6", "个月以上")
TAG_CATEGORIES = ("tech", "project", "domain", "industry", "education", "language", "general")
TAG_LIMITS = {"tech": 8, "project": 4, "domain": 4, "industry": 3, "education": 4, "language": 3, "general": 3}
TAG_BLOCKLIST = ("engineer", "developer", "software", "job", "position", "experience", "responsibility", "responsibilities", "requirement", "requirements", "fulltime", "full-time", "intern", "internship", "campus", "remote", "onsite", "hybrid")
DEGREE_WORDS = (("博士", "phd"), ("phd", "phd"), ("doctor", "doctor"), ("硕士", "master"), ("master", "master"), ("mba", "mba"), ("本科", "bachelor"), ("学士", "bachelor"), ("大专", "associate"), ("专科", "associate"), ("高中", "high_school"))
