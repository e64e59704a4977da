from pyspark.sql import functions as F

from rolecast.functions import facets, parsing, skills, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).collect()[0]["x"]


def test_lists_and_strings(spark):
    assert one(spark, text.dedupe_ci(F.col("a")), a=[" Go", "go", "", "Vue", None, "VUE "]) == ["Go", "Vue"]
    assert one(spark, text.strip(F.col("a")), a="　 x\t") == "x"
    assert one(spark, text.city_tokens(F.col("a")), a="上海市、[北京]/上海，市") == ["上海", "北京", "市"]
    assert sorted(one(spark, text.match_cities(F.col("a")), a="上海市·浦东 (北京)")) == ["上海", "北京", "浦东"]
    assert one(spark, text.json_string_list(F.col("a")), a='["x", "y"]') == ["x", "y"]
    assert one(spark, text.json_string_list(F.col("a")), a="plain") == ["plain"]
    assert one(spark, text.bullet_items(F.col("a")), a="1. build the service；2. keep it running\n• 第三项事情写在这里。第四项事情写在这里") == ["build the service", "keep it running", "第三项事情写在这里", "第四项事情写在这里"]
    assert one(spark, text.section_text(F.col("a"), "岗位职责", ("任职要求",)), a="x 岗位职责：做事\n任职要求：会") == "做事"
    assert one(spark, text.scrub_contacts(F.col("a")), a="电话：13812345678, mail a.b@c.org 微信 x12345678 hello") == "hello"


def test_skill_boundaries(spark):
    got = lambda t: one(spark, skills.extract_skills(F.col("a")), a=t)
    assert got("Docker, python and SpringBoot; k8s") == ["Docker", "Python", "Spring Boot", "Kubernetes"]
    assert got("熟悉java开发") == [] and got("熟悉 Java 开发") == ["Java"]  # letters on both sides are one word
    assert got("C++ ") == [] and got("c++11") == ["C++"]
    assert got("javascript") == ["JavaScript"]
    expand = lambda t, **k: one(spark, skills.expand_skill(F.col("a"), **k), a=t)
    assert expand("Vue/React（TypeScript）") == ["Vue", "React", "TypeScript"]
    assert expand("ES6+") == ["ES6"] and expand("C++") == ["C"] and expand("C++", strip_plus=False) == ["C++"]
    assert one(spark, skills.normalize_skill(F.col("a")), a=" ReactJS ") == "react"


def test_parsers(spark):
    pay = one(spark, parsing.parse_salary(F.col("a")), a="15-25K·13薪")
    assert (pay["min"], pay["max"], pay["months_min"], pay["negotiable"]) == (15000, 25000, 13, False)
    assert one(spark, parsing.parse_salary(F.col("a")), a="面议")["negotiable"] is True
    assert one(spark, parsing.parse_salary(F.col("a"), True), a="150-200元/天")["intern_amount"] == 200
    years = one(spark, parsing.parse_years(F.col("a")), a="3年以上")
    assert (years["min"], years["max"]) == (3.0, None)
    edu = one(spark, parsing.education_constraints(F.col("a")), a="本科及以上，计算机、软件工程相关专业优先，英语六级，25-35岁")
    assert edu["min_degree"] == "bachelor" and edu["preferred_majors"][-1] == "软件工程" and edu["age_range"] == "25-35岁"
    assert [(x["language"], x["level"]) for x in edu["languages"]] == [("英语", "advanced")]
    when = one(spark, parsing.posted(F.lit("2024-01-31").cast("date"), F.col("a"), F.col("b")), a="nothing", b="2024-01-20T10:00:00Z")
    assert when["posted_days_ago"] == 11
    assert one(spark, parsing.job_id(F.col("a"), F.col("a"), F.col("b"), F.col("b")), a=None, b="http://x.org/jobs/123.html") == "123"
    assert one(spark, parsing.month_index(F.col("a"), F.lit("2024-03-01").cast("date")), a="至今") == 2024 * 12 + 3
    assert one(spark, parsing.split_title(F.col("a"))["title"], a="Java 开发 岗位职责：写") == "Java 开发"


def test_bands(spark):
    band = one(spark, facets.experience_band(F.lit(None).cast("boolean"), F.lit("senior x"), F.lit(4.0), F.lit(None).cast("double")))
    assert tuple(band) == (4.0, 10.0, "senior")
    assert one(spark, facets.inferred_salary(F.lit(9), F.lit("lead"), text.strings("backend_engineer"), F.lit("上海"), F.lit("LLM"))).asDict() == {"min": 42000, "max": 61000}


def test_items_and_sections(spark):
    items = lambda t: one(spark, text.bullet_items(F.col("a")), a=t)
    assert items("三、与团队　-　一起把事做好\r任职要求：会写代码的人；Shorter; shorter; 短") == ["一起把事做好", "会写代码的人", "Shorter"]
    assert items("这里讲岗位职责是什么；这里讲其他的事情") == ["这里讲其他的事情"] and items("") == []  # an item that holds a marker of a part goes
    body = "介绍。工作内容：短；岗位职责：1、负责服务的开发；2、负责服务的维护 任职要求：本科学历优先考虑 加分项：熟悉开源项目；前端/后端/测试；提供餐补和班车"
    assert one(spark, parsing.responsibilities(F.col("a")), a=body) == ["负责服务的开发", "负责服务的维护"]
    assert one(spark, parsing.highlights(F.col("a")), a=body) == ["熟悉开源项目", "提供餐补和班车"]
    assert one(spark, parsing.responsibilities(F.col("a")), a="没有任何部分的文字") == []
    assert one(spark, parsing.highlights(F.col("a")), a="我们有弹性工作时间；硕士优先的岗位；写代码的工作") == ["我们有弹性工作时间"]
    assert one(spark, parsing.education_constraints(F.col("a")), a="计算机　数学相关专业")["required_majors"] == ["计算机", "数学"]


def test_occurrences(spark):
    """Against a plain loop: places, neighbours, matches at both ends, beside each other, beyond the plane of 16 bits, and thousands of them."""
    import re

    pattern, reach = "(?i:ab|b1)", 5
    texts = ["", "none", "ab", "xAB", "abab b1", "😀ab😀b1 and\nab\n", "abb1" * 700 + "tail", "x" * 5000 + "ab" + "y" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", text.occurrences(F.col("t"), pattern, reach).alias("m"))
    got = {r["i"]: r["m"] and [tuple(x) for x in r["m"]] for r in rows.collect()}
    for i, t in enumerate(texts):
        want = [(m.start() + 1, m.group(), t[max(0, m.start() - reach) : m.start()], t[m.end() : m.end() + reach]) for m in re.finditer("ab|b1", t, re.IGNORECASE)]
        assert (got[i] or []) == want
    assert got[len(texts)] is None
    found = one(spark, parsing.language_mentions(F.col("a")), a="英语CET-6流利" + "。" * 40 + "英文优先")
    assert [(x["language"], x["at"], x["hit"], x["level"], x["required"]) for x in found] == [("英语", 1, "英语", "fluent", True), ("英语", 3, "CET-6", "fluent", True), ("英语", 50, "英文", None, False)]


def test_labels(spark):
    from rolecast.operators import normalize

    work = lambda **k: F.struct(*[F.lit(k.get(n)).cast("string").alias(n) for n in ("title", "company_name", "industry", "location", "level")], *[text.strings(*k.get(n, ())).alias(n) for n in ("tech_stack", "responsibilities", "achievements")])
    head = lambda **k: one(spark, normalize.experience_headline(work(**k)))
    assert head(title="Role pending", company_name="某公司") == "某公司" and head() == "开发经历"
    assert head(tech_stack=("Vue",)) == "前端开发经历" and head(tech_stack=("uniapp",)) == "全栈开发经历" and head(achievements=("完成服务端",)) == "后端开发经历"
    assert head(responsibilities=("写" * 30,)) == "写" * 23 + "…"
    assert one(spark, normalize.experience_meta(work(title="x", company_name=" ", location="上海"))) == "上海"
    assert one(spark, normalize.experience_note(work(tech_stack=("a", "A", "b", "c", "d", "e")))) == "技术栈：a / b / c / d"
    assert one(spark, text.compact_range(F.lit(3.0), F.lit(None).cast("double"), " 年")) == "3 年"
