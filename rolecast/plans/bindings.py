"""Openings, people and what joins them, as projections of the given tables: one SQL text for Spark and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Fixed values of the projections: titles, pay lines and requirements by remainder of a key, cities by nation.
TITLES = ("Senior Java Developer", "前端开发工程师 Vue", "Golang后端开发", "Embedded Engineer Intern", "算法工程师（大模型）", "Data Platform Engineer", "QA Test Engineer", "产品经理", "2025届校招 Python开发", "架构师 React", "Mobile App Developer Flutter")
PAY = ("15-25K·13薪", "8000-12000元/月", "1.5-2万", "面议", "20-30万/年", "150-200元/天", "30k-45k 14-16薪")
NEEDS = ("3-5年经验，本科及以上，熟悉Python、Docker", "5年以上经验，硕士优先，英语六级，计算机相关专业优先", "经验不限，大专及以上，Redis和MySQL", "1年，本科学历，日语N2优先，PMP", "应届毕业生，CET-4，25-35岁", "2 years experience in Kubernetes or k8s, fluent", "10年以上，博士研究生，35岁以下，k8s/Kafka")
SUMMARIES = ("remote work from home, react native and ios", "熟悉java开发 C++11 and node.js", "hybrid, machine learning platform with RAG agent", "驻场 银行 高并发 分布式", "springboot mysql redis kafka", "web前端 h5开发 设计师", "sql etl 大数据 数仓")
CITIES = ("上海", "杭州", "苏州", "北京", "天津", "深圳", "广州", "成都市", "remote", "佛山")
ROLES = ("frontend_engineer", "backend_engineer", "fullstack_engineer", "algorithm_engineer", "data_engineer", "testing_engineer")


def case(key: str, values: tuple, n: int | None = None) -> str:
    return f"CASE {key} % {n or len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


BINDINGS = {
    "fx_jobs": f"""SELECT p_partkey AS job_id, p_name AS title, p_brand AS company, p_partkey % 25 AS city_key,
 CASE WHEN p_type='PROMO' THEN true ELSE false END AS is_internship, CASE WHEN p_partkey % 7 = 0 THEN true ELSE false END AS salary_negotiable,
 6000 + (p_partkey % 200) * 100 AS salary_min, 9000 + (p_partkey % 200) * 130 AS salary_max, p_size % 9 AS min_years,
 CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 9 + 4 END AS max_years, p_partkey % 6 AS min_degree_rank, p_partkey % 120 AS posted_days_ago, p_type AS role_category,
 {case("p_partkey", ROLES)} AS role, CASE WHEN p_partkey % 11 = 0 THEN 'remote' ELSE 'onsite' END AS work_mode FROM {{part}}""",
    "fx_resumes": f"""SELECT c_custkey AS resume_id, c_nationkey AS city_key, c_custkey % 13 AS years,
 CASE WHEN c_acctbal <= 0 THEN 0 ELSE 8000 + CAST(floor(c_acctbal/1000) AS INT)*1000 END AS exp_min, CASE WHEN c_acctbal <= 0 THEN 0 ELSE 14000 + CAST(floor(c_acctbal/1000) AS INT)*1000 END AS exp_max,
 c_custkey % 6 AS degree_rank, c_mktsegment AS segment, {case("c_custkey", ROLES)} AS role FROM {{customer}}""",
    "fx_wishes": """SELECT c_custkey AS resume_id, CASE WHEN c_custkey % 8 = 1 THEN 'backend_engineer' END AS want_role, CASE WHEN c_custkey % 9 = 2 THEN 'remote' END AS want_mode,
 CASE c_custkey % 10 WHEN 3 THEN 'intern' WHEN 4 THEN 'fulltime' ELSE 'all' END AS want_internship, CASE WHEN c_custkey % 6 = 0 THEN 60 END AS want_days,
 CASE WHEN c_custkey % 7 = 5 THEN 3 END AS want_min_years, CASE WHEN c_custkey % 7 = 6 THEN 5 END AS want_max_years FROM {customer}""",
    "fx_pairs": """SELECT resume_id, job_id, vector, CAST(row_number() OVER (PARTITION BY resume_id ORDER BY vector DESC, job_id) AS INT) AS recall_rank FROM
 (SELECT o_custkey AS resume_id, l_partkey AS job_id, round(max(0.5E0 + 4E0 * l_discount), 4) AS vector FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey)""",
    "fx_cand_skill": """SELECT o.o_custkey AS resume_id, split_part(p.p_name,' ',2) AS skill, l.l_linenumber % 5 AS level_rank, CASE WHEN l.l_linenumber % 3 = 0 THEN NULL ELSE l.l_quantity / 10 END AS years,
 CAST(CASE WHEN l.l_returnflag='R' THEN 0.92 ELSE 1.0 END AS DOUBLE) AS confidence FROM {orders} o JOIN {lineitem} l ON o.o_orderkey=l.l_orderkey JOIN {part} p ON l.l_partkey=p.p_partkey""",
    "fx_skill_index": """SELECT resume_id, skill AS norm, CAST(max(level_rank) AS DOUBLE) AS level_rank, max(years) AS years, max(confidence) AS confidence FROM fx_cand_skill GROUP BY resume_id, skill""",
    "fx_job_skill": """SELECT p_partkey AS job_id, 'required' AS kind, 0 AS group_pos, 1 AS pos, split_part(p_name,' ',2) AS skill, p_size % 5 AS level_rank, CAST(CASE WHEN p_size % 4 = 0 THEN 3 END AS DOUBLE) AS min_years, CAST(NULL AS INT) AS weight, CAST(NULL AS INT) AS min_required FROM {part}
 UNION ALL SELECT p_partkey, 'required', 0, 2, split_part(p_name,' ',1), 0, NULL, NULL, NULL FROM {part} WHERE p_size % 3 = 0
 UNION ALL SELECT p_partkey, 'optional', p_size % 2, 3, lower(p_type), 0, NULL, NULL, 1 FROM {part} WHERE p_size % 5 < 2
 UNION ALL SELECT p_partkey, 'optional', 1, 4, split_part(p_name,' ',2), 2, NULL, NULL, 2 FROM {part} WHERE p_size % 5 < 3
 UNION ALL SELECT p_partkey, 'bonus', 0, 5, split_part(p_name,' ',1), 0, NULL, p_size % 4, NULL FROM {part}
 UNION ALL SELECT p_partkey, 'bonus', 0, 6, split_part(p_name,' ',2), 0, NULL, 2, NULL FROM {part} WHERE p_size % 2 = 0""",
    "fx_vec": """SELECT vec_id, CASE WHEN vec_id % 10 < 2 THEN 'resumes' ELSE 'jobs' END AS namespace, embedding FROM {embeddings}""",
    "fx_rank": """SELECT o_custkey AS resume_id, o_orderkey AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank_a,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS rank_b FROM {orders}""",
    "fx_text": f"""SELECT p_partkey AS job_id, {case("p_partkey", TITLES)} AS title, {case("p_size", SUMMARIES)} AS summary, {case("p_partkey + p_size", PAY, 7)} AS pay, {case("p_size", NEEDS)} AS needs,
 concat({case("p_partkey", CITIES)}, CASE WHEN p_size % 3 = 0 THEN '、杭州市' ELSE '' END) AS location, p_brand AS company, p_name AS part_name, p_size % 9 AS min_years, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 9 + 4 END AS max_years,
 CASE WHEN p_size % 4 = 0 THEN 0 ELSE 6000 + (p_partkey % 200) * 130 END AS salary_max FROM {{part}}""",
    "fx_people": f"""SELECT c_custkey AS resume_id, {case("c_custkey", TITLES)} AS title, {case("c_custkey", SUMMARIES)} AS summary, c_custkey % 13 AS years, {case("c_custkey", CITIES)} AS city,
 CASE c_custkey % 4 WHEN 0 THEN concat('意向城市：', {case("c_custkey + 3", CITIES, 10).replace("c_custkey + 3 %", "(c_custkey + 3) %")}, '、深圳') WHEN 1 THEN '10年工作经验 remote LLM' WHEN 2 THEN '架构师 负责人' ELSE '' END AS raw_text FROM {{customer}}""",
    "fx_messy": """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN '  Company   Pending ' WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN concat('http://x.org/', c_custkey) WHEN 4 THEN concat('a', c_custkey, '@mail.org')
 WHEN 5 THEN concat('13', lpad(CAST(c_custkey AS VARCHAR(20)), 9, '0')) WHEN 6 THEN concat(' ', c_name, ' ') WHEN 7 THEN 'Skill pending.' ELSE concat('Go; ', c_mktsegment, ' go,，', lower(c_mktsegment), '/ Vue | vue') END AS raw,
 CASE c_custkey % 6 WHEN 0 THEN '2.5' WHEN 1 THEN ' 3.5 ' WHEN 2 THEN 'x' WHEN 3 THEN '-1' WHEN 4 THEN CAST(c_custkey AS VARCHAR(20)) END AS num FROM {customer}""",
}
BINDINGS["fx_text"] = BINDINGS["fx_text"].replace("p_partkey + p_size % 7", "(p_partkey + p_size) % 7")
#: Projections whose rows are worked on for long, and the key that deals their table's rows.
_SPREAD = {"fx_text": "p_partkey", "fx_people": "c_custkey"}
ROWS_A_TASK = 5_000
#: Names of other projections that a projection reads.
_NEEDS = {"fx_skill_index": ["fx_cand_skill"]}


def chain(names) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*chain(_NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def with_ctes(names, query: str) -> str:
    """DuckDB SQL: the projections as common table expressions before the query."""
    parts = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in chain(names)).format(**{t: t for t in TABLES})
    head, rest = ("WITH " + parts, query.strip())
    if rest.upper().startswith("WITH "):
        return f"{head}, {rest[5:]}"
    return f"{head} {rest}"


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection as a DataFrame over the tables in ``sf_dir``; texts and people in many tasks, as each row takes long."""
    text = "WITH " + ", ".join(f"{n} AS ({BINDINGS[n]})" for n in chain([name])) + f" SELECT * FROM {name}"
    used = [t for t in TABLES if "{" + t + "}" in text]
    key = _SPREAD.get(name)
    return spark.sql(text, **{t: spread(read(spark, sf_dir, t), key) if key else read(spark, sf_dir, t) for t in used})


def spread(df: DataFrame, key: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df dealt by its key to tasks of some ``rows`` rows, to more and smaller ones where that leaves cores idle.

    For small tables whose rows take long: files of a few megabytes are read in a task or two, whatever is done with a row.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n // rows), min(2 * cores, n // 200))
    return df.repartition(int(tasks), key) if tasks > 1 else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def sql_categories(text: str, words: dict) -> str:
    """DuckDB: the categories one of whose words the text contains, comma-joined in dictionary order."""
    return "coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {sql_any(text, w)} THEN {quoted(k)} END" for k, w in words.items()) + "], lambda x: x IS NOT NULL), ','), '')"
