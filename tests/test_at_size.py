"""Queries against their SQL on rows that the smallest tables lack."""

import duckdb
from pyspark.sql import functions as F

from rolecast import plans
from rolecast.functions import dictionaries as D
from rolecast.functions import facets, parsing

from .test_queries import rows


def same_as_sql(spark, folder, name, tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    result = c.execute(plans.ORACLES[name])
    names, want = [d[0] for d in result.description], result.fetchall()
    df = plans.QUERIES[name](spark, str(folder))
    assert rows(df.columns, df.collect()) == rows(names, want)
    return df


def test_digests_that_hold_a_mobile_number(spark, tmp_path):
    texts = ['token = "18945874088f67dc02ebee7da32856e8cab6c30f" end', "call 13812345678 or a.b@c.org", "x13812345678", "电话：13812345678", None]
    duckdb.connect().execute(f"copy (select unnest(range({len(texts)})) as doc_id, unnest(?) as text) to '{tmp_path}/documents.parquet'", [texts])
    same_as_sql(spark, tmp_path, "contacts_scrubbed", ["documents"])


def test_scores_at_the_edges(spark, tmp_path):
    prices = [0.0, 48148.5, 96748.5, 195148.5, 300000.0, 300000.01, 300001.49, 300002.0, -0.01, -3000.0, None]
    duckdb.connect().execute(f"copy (select unnest(range({len(prices)})) as o_orderkey, unnest(?::double[]) as o_totalprice) to '{tmp_path}/orders.parquet'", [prices])
    same_as_sql(spark, tmp_path, "score_payloads", ["orders"])


def test_dumps_in_several_splits(spark):
    """As large files are read: by splits, of which only the first has a header."""
    from .test_queries import DATA

    given = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in given.items():
        spark.conf.set(k, v)
    try:
        same_as_sql(spark, DATA, "dump_tables", ["customer", "part"])
    finally:
        for k in given:
            spark.conf.unset(k)


def test_slow_rows_are_dealt_to_many_tasks(spark, tmp_path):
    """A small file is read in one task; texts and people of it are not worked on in one."""
    from rolecast.plans.bindings import bind

    c = duckdb.connect()
    c.execute(f"copy (select i as p_partkey, 'a b' as p_name, 'B' as p_brand, 'T' as p_type, (i % 50)::int as p_size, 1.0 as p_retailprice from range(4000) r(i)) to '{tmp_path}/part.parquet'")
    c.execute(f"copy (select i as c_custkey, 'n' as c_name, 1 as c_nationkey, 1.0 as c_acctbal, 's' as c_mktsegment from range(4000) r(i)) to '{tmp_path}/customer.parquet'")
    for name in ("fx_text", "fx_people"):
        sizes = [r["n"] for r in bind(spark, str(tmp_path), name).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 500


def test_fields_of_study_against_a_plain_search(spark):
    """Runs cut at the last 专业 hold the same matches as the whole text."""
    import re

    letters = r"[一-龥A-Za-z/、，,\s]"
    texts = ["计算机、软件工程等相关专业优先", "a" * 100 + "数学专业者优先，统计专业", "专业", "x专业优先\n计算机 相关专业。土木：相关专业优先者优先专业优先", "无", "", "，" * 300 + "专业优先" + "字" * 300, "1专业2计算机专业3软件/网络相关专业者优先4", None]
    texts += [("软件、" * n + "相关专业" + "优先" * (n % 2) + "。" * (n % 3) + "Math专业者优先") * 2 for n in range(1, 40, 7)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: (r["a"], r["b"]) for r in df.select("i", parsing.majors(F.col("t"), False).alias("a"), parsing.majors(F.col("t"), True).alias("b")).collect()}
    assert got[len(texts[:8])] == (None, None)
    for i, t in enumerate(texts):
        for preferred in (False, True) if t is not None else ():
            found = [m for p in ("相关专业(?:优先|者优先)?", "专业(?:优先|者优先)") for m in re.finditer(f"({letters}{{2,80}}?)(?:等)?{p}", t)]
            names = [re.sub(r"\d{4}届|海内外|统招|学历|及以上|或研究生|或以上|以上", "", re.sub(".*学历", "", m[1])) for m in found if ("优先" in m[0]) == preferred]
            tokens = [re.sub("(专业|类)$", "", re.sub("(相关专业|相关)$", "", x.strip())).strip() for n in names for x in re.split(r"[、,/，]\s*|\s+", n)]
            want = list(dict.fromkeys(x.lower() for x in tokens if len(x) >= 2 and x not in D.MAJOR_STOPWORDS))
            assert [x.lower() for x in got[i][preferred]] == want, (i, preferred)


def test_category_words_meet_one_copy_of_the_text(spark):
    """The lowered text is made once a row, not once a word."""
    plan = spark.createDataFrame([("Java", "b")], "a string, b string").select(facets.role_categories(F.col("a"), F.col("b")).alias("r"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("lower(concat_ws") == 1


def test_texts_of_experience_items_are_read_once_an_opening(spark):
    """Patterns of skills meet the items of an opening, not those of each of its pairs."""
    from rolecast.config import DEFAULT
    from rolecast.plans import engine

    said = str(engine.experience_match(DEFAULT)).lower()
    assert "regexp_instr" not in said and "rlike" not in said and "from_json" not in said


def test_skills_of_pairs_without_a_row_for_each(spark):
    """The row of a pair gives what its exploded skills give, and no row of an asked skill is dealt by person and skill."""
    import re

    from rolecast.operators import skills as K

    from .test_queries import DATA

    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (1, 3)], "resume_id long, job_id long")
    asked = [(1, "required", 0, 1, "Go", "go", 2, 3.0, None, None), (1, "required", 0, 3, "Vue", "vue", 0, None, None, None), (1, "optional", 1, 1, "x", "x", 3, None, None, 2), (1, "optional", 1, 2, "go", "go", 0, None, None, 1), (1, "optional", 0, 3, "vue", "vue", 1, None, None, None),
             (1, "bonus", 0, 1, "go", "go", 0, None, 3, None), (1, "bonus", 0, 2, "x", "x", 0, None, 0, None), (2, "bonus", 0, 1, "no", None, 0, None, None, None), (3, "optional", 0, 1, "go", "go", 1, None, None, 3)]
    asked = spark.createDataFrame(asked, "job_id long, kind string, group_pos int, pos int, skill string, norm string, level_rank int, min_years double, weight int, min_required int")
    index = spark.createDataFrame([(1, "go", 1.0, None, 0.92), (1, None, 1.0, 1.0, 1.0), (2, "vue", 0.0, 2.0, 1.0), (2, "go", 4.0, 2.0, 1.0), (2, "x", None, 9.0, 0.8)], "resume_id long, norm string, level_rank double, years double, confidence double")
    names = ("resume_id", "job_id", "required", "primary", "optional", "bonus", "n_required", "matched", "missing")
    want = K.skill_scores(K.pair_skills(pairs, asked, index)).select(*names).orderBy("resume_id", "job_id").collect()
    got = K.with_skill_scores(pairs.join(K.asked_arrays(asked), "job_id").join(K.owned_maps(index), "resume_id", "left")).select(*names).orderBy("resume_id", "job_id").collect()
    tidy = lambda rows: [[round(v, 12) if isinstance(v, float) else v for v in r] for r in rows]
    assert len(got) == 5 and tidy(got) == tidy(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["recommend"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(resume_id#\w+, (norm|job_id)#", plan) and "vec_id" not in " ".join(re.findall(r"hashpartitioning\([^)]*\)", plan))


def test_vectors_go_once_to_a_part_of_cells(spark, monkeypatch):
    """Of ungrouped vectors nearly all cells are read; a query must not be written once for each of them."""
    import numpy as np

    from rolecast.operators import recall

    rng, written = np.random.default_rng(5), []
    side = lambda n, key: spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(n)], f"{key} long, vector array<double>")
    people, jobs, plain = side(40, "resume_id"), side(900, "job_id"), recall.staged
    monkeypatch.setattr(recall, "staged", lambda df: written.append(plain(df)) or written[-1])
    got = recall.pruned_top_n(people, jobs, 5)
    assert sorted(map(tuple, got.select("resume_id", "job_id", "recall_rank").collect())) == sorted(map(tuple, recall.top_n(people, jobs, 5).select("resume_id", "job_id", "recall_rank").collect()))
    assert max(df.count() for df in written if "angle" not in df.columns and "score" not in df.columns) <= 40


def test_skills_by_constant_patterns_over_one_copy_of_the_text(spark):
    """A pattern out of an array is compiled again for every row, and a text within its look-up is made again for every pattern."""
    from rolecast.functions import skills

    texts = ["Spring Boot, spring; c#7 then Java then CSharp", "csharp java c#7", "自动化测试开发 PostgresQL", "K8S kubernetes", "javascript2 mysqlx", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", skills.extract_skills(F.concat("t", F.lit(" LLM大模型"))))
    got = [r["s"] for r in df.orderBy("i").collect()]
    assert got == [["Spring", "Spring Boot", "C#", "Java", "LLM"], ["Java", "C#", "LLM"], ["自动化测试", "测试开发", "PostgreSQL", "LLM"], ["Kubernetes", "LLM"], ["LLM"], ["LLM"], []]
    plan = df.select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat(t") == 1 and "regexp_instr(lambda" in plan and ", lambda p" not in plan


def test_words_of_dictionaries_meet_one_copy_of_the_record(spark):
    """The fingerprint lowers a record's text once, not once a word."""
    from rolecast.operators import retagging

    df = spark.createDataFrame([("a", "Senior KAFKA", "Go"), ("b", None, "kafka")], "id string, title string, summary string")
    plan = df.select(retagging.fingerprint(df, {"x": ("kafka", "go")}).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower(" not in plan.lower()


def test_parts_of_markers_that_a_posting_lacks_are_not_read(spark):
    """Rules of items stand once for all markers, and only markers that the text holds go through them."""
    assert str(parsing.highlights(F.col("t"))).count("一二三四五六七八九十") == 2
    texts = ["工作内容：负责日常开发。参与系统维护\n任职要求：x\n加分项：有弹性工作时间；项目有奖金", "岗位职责：职责要求：负责日常开发工作", "加分项：另有班车和餐补福利", "职责(x) a.b 任职要求", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parsing.responsibilities(F.col("t")).alias("d"), parsing.highlights(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r["d"] for r in rows] == [["负责日常开发", "参与系统维护"], [], [], ["x) a.b"], [], []]
    assert [r["h"] for r in rows] == [["有弹性工作时间"], [], ["另有班车和餐补福利"], [], [], None]


def test_white_space_at_the_ends_without_a_pattern(spark):
    """Texts are stripped of what a pattern for Unicode's white space finds, with no pattern run on them."""
    from rolecast.functions import text

    texts = [f"{chr(c)}x{chr(c)}y{chr(c)}{chr(c)}" for c in range(0x10000) if not 0xD800 <= c < 0xE000] + ["", " \r\n", "a\r\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~text.strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in str(text.strip(F.col("t")))


def test_names_of_tags_are_made_once(spark):
    from rolecast.functions import text

    assert str(text.slug(F.col("a"))).count("regexp_replace") == 2
    rows = spark.createDataFrame([("　Big Data\u2003",), ("--",), (None,)], "a string")
    assert [r["s"] for r in rows.select(text.slug(F.col("a")).alias("s")).collect()] == ["big_data", None, None]


def test_pools_of_those_who_lack_without_ranking_all_items(spark, monkeypatch):
    """Who never gets enough must not have all items ranked and written, and the rows are still those of a whole ranking."""
    import numpy as np

    from rolecast.operators import recall

    rng, written, plain = np.random.default_rng(7), [], recall.staged
    some = rng.normal(size=(300, 8))
    side = lambda rows, key: plain(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"{key} long, vector array<double>"))
    people = side([*rng.normal(size=(18, 8)).tolist(), [0.0] * 8, None, [1.0, -2.0]], "resume_id")
    jobs = side([*some.tolist(), *some.tolist(), [0.0] * 8, None, [1.0, 2.0, 3.0]], "job_id")  # copies are ties
    rule = "CASE resume_id % 4 WHEN 0 THEN job_id % 3 = 0 WHEN 1 THEN job_id % 40 = 3 WHEN 2 THEN job_id IN (5, 305) OR job_id > 601 ELSE false END"
    passes = lambda pairs: pairs.withColumn("passed", F.expr(rule))
    want = recall.candidate_pool(plain(passes(recall.top_n(people, jobs, 603))), 4, 4, F.lit(1))
    names = ("resume_id", "job_id", "recall_rank", "pool_rank", "recall_n", "score")
    key = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
    monkeypatch.setattr(recall, "staged", lambda df: written.append(plain(df)) or written[-1])
    for block in (16_384, 64):  # with one part of the items and with many
        got = key(recall.widened_pool(people, jobs, passes, 4, 1, block=block))
        assert got == key(want) and {r[0] % 4 for r in got} == {0, 1, 2}
        assert max(r[2] for r in got) > 64 and {r[4] for r in got} >= {4, 8, 603}
    ranked = [df for df in written if "recall_rank" in df.columns]
    assert ranked and all(df.groupBy("resume_id").count().agg(F.max("count")).first()[0] in (None, *range(65)) for df in ranked)


def test_a_sample_that_misleads_costs_no_row(spark):
    """Floors from a sample are too high for people near its items; these are looked at again."""
    import numpy as np

    from rolecast.operators import recall

    rng = np.random.default_rng(3)
    jobs = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(3000, 6)).tolist())], "id long, v array<double>")
    sampled = [r["v"] for r in jobs.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0).limit(3).collect()]
    jobs = jobs.withColumn("v", F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0, F.array(*[F.lit(x) for x in sampled[0]])).otherwise(F.col("v")))
    people = spark.createDataFrame(list(enumerate([sampled[0], sampled[1], rng.normal(size=6).tolist()])), "id long, v array<double>")
    for n in (7, 1600, 3000):
        got = recall.listed_top_n(people, jobs, 3, 3000, n, "p", "j", block=1024)
        want = recall.top_n(people.toDF("p", "vector"), jobs.toDF("j", "vector"), n, "p", "j")
        assert sorted(map(tuple, got.select("p", "j", "score", "recall_rank").collect())) == sorted(map(tuple, want.select("p", "j", "score", "recall_rank").collect()))


def test_pairs_of_the_engine_meet_each_side_once(spark):
    """Pairs are made once, move to their opening once, and no asked skill of a pair is shuffled; terms of openings are made once an opening."""
    import re

    from rolecast.config import DEFAULT
    from rolecast.plans import engine

    from .test_queries import DATA

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.QUERIES["engine_matches"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(resume_id#\w+, job_id#", plan) and plan.count("ReadSchema: struct<l_orderkey") == 1
    assert len(re.findall(r"hashpartitioning\(resume_id#\w+, norm#", plan)) == 1  # that of the people's skills, whose texts are read once
    assert "trim(" not in str(engine.experience_match(DEFAULT))
