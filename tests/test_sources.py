import datetime
import json

import pytest
from pyspark.sql import functions as F

from rolecast import schemas
from rolecast.operators import maintain, normalize, recall, retagging
from rolecast.operators.snapshots import SnapshotTable
from rolecast.sources import dumps, records
from rolecast.storage import staged
from rolecast.streaming import incremental as S

DAY = datetime.date(2026, 1, 31)
STANDARD = {"id": "7", "title": "Java 后端", "company": "Acme", "summary": "负责后端服务", "description": "岗位职责：1. 开发后端服务接口；2. 维护线上系统稳定\n任职要求：本科及以上，3-5年", "salary": "15-25K·13薪", "experience": "3-5年", "location": "上海市", "posted_at": "2026-01-21"}
BOARD_A = {"job_name": "前端开发", "jd": "熟悉 Vue 和 TypeScript", "salary": "8000-12000元/月", "city": "北京", "education": "本科", "experience": "经验不限", "skill_tags": ["Vue", "沟通"], "company_industry": "互联网,金融", "_detail_url": "http://x.org/job/99.html", "company_name": "B"}
BOARD_B = {"job_name": "数据工程师", "jd": json.dumps({"requirements": "Python SQL", "infos": "数仓"}), "job_keys": "Python、ETL"}


def write(path, data):
    path.write_text(json.dumps(data, ensure_ascii=False))
    return str(path)


def test_json_layouts(spark, tmp_path):
    for root in ([STANDARD, BOARD_A, BOARD_B], {"jobs": [STANDARD, BOARD_A, BOARD_B]}):
        rows = records.map_boards(records.read_jobs_json(spark, write(tmp_path / "j.json", root))).collect()
        by = {r["dialect"]: r for r in rows}
        assert set(by) == {"standard", "board_a", "board_b"}
        assert (by["standard"]["id"], by["standard"]["pay"]["min"], by["standard"]["years"]["max"]) == ("7", 15000, 5.0)
        assert (by["board_a"]["id"], by["board_a"]["min_degree"], by["board_a"]["general"], by["board_a"]["industry"]) == ("99", "bachelor", ["沟通"], ["互联网", "金融"])
        assert by["board_b"]["skills"] == ["Python", "SQL", "ETL"] and "数仓" in by["board_b"]["text"]
    assert records.read_jobs_json(spark, str(tmp_path / "j.json"), 2).count() == 2
    with pytest.raises(Exception, match="list of openings"):
        records.read_jobs_json(spark, write(tmp_path / "k.json", {"other": 1})).collect()


def test_normalized_jobs_fit_the_schema(spark, tmp_path):
    flat = records.map_boards(records.read_jobs_json(spark, write(tmp_path / "j.json", [STANDARD, BOARD_A])))
    jobs = normalize.normalize_jobs(flat, F.lit(DAY))
    want = spark.createDataFrame([], schemas.JOB).schema
    assert [f.name for f in jobs.schema.fields] == [f.name for f in want.fields]
    row = {r["id"]: r for r in jobs.collect()}["7"]
    assert row["basic_info"]["responsibilities"] == ["开发后端服务接口", "维护线上系统稳定"]
    assert row["filter_facets"]["posted_days_ago"] == 10 and row["filter_facets"]["role_categories"] == ["backend_engineer"]
    assert row["education_constraints"]["min_degree"] == "bachelor" and [s["name"] for s in row["skill_requirements"]["required"]] == ["Java"]
    model = spark.createDataFrame([("7", "Better title", None, None, ["Go"], None)], "id string, title string, summary string, location string, skills array<string>, min_degree string")
    again = {r["id"]: r for r in normalize.normalize_jobs(flat, F.lit(DAY), model).collect()}["7"]
    assert again["basic_info"]["title"] == "Better title" and [s["name"] for s in again["skill_requirements"]["required"]] == ["Go"]


def test_retag_reports_changes_only(spark, tmp_path):
    flat = records.map_boards(records.read_jobs_json(spark, write(tmp_path / "j.json", [STANDARD, BOARD_A])))
    stored = staged(normalize.normalize_jobs(flat, F.lit(DAY)))
    old = stored.withColumn("tags", F.when(F.col("id") == "7", F.slice("tags", 1, 1)).otherwise(F.col("tags")))
    changed, counts = normalize.retag(old, flat, F.lit(DAY))
    assert [(r["id"], r["changed"]) for r in changed.collect()] == [("7", ["tag_names"])]
    assert any(r["n_after"] > r["n_before"] for r in counts.collect())


def test_refresh_of_stale_records_only(spark, tmp_path):
    posting = lambda i, summary, company="Acme": {"id": str(i), "title": "Role", "summary": summary, "company": company}
    read = lambda rows: staged(records.map_boards(records.read_jobs_json(spark, write(tmp_path / f"{len(rows)}-{hash(str(rows))}.json", rows))))
    old = read([posting(1, "kafka streams"), posting(2, "vue pages"), posting(3, "cooking"), posting(4, "remote")])
    entries = retagging.dictionary_entries()
    nothing = spark.createDataFrame([], normalize.normalize_jobs(old, F.lit(DAY)).schema)
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())

    first = retagging.refresh_tags(nothing, spark.createDataFrame([], "id string, fingerprint string"), old, F.lit(DAY), entries)
    assert ids(first.stale) == ids(first.table) == ids(first.marks) == ["1", "2", "3", "4"]

    def stale(dictionary, rules=retagging.RULES):
        now = old.select("id", retagging.fingerprint(old, dictionary, rules).alias("now"))
        return ids(now.join(first.marks, "id").filter("now <> fingerprint"))

    assert stale(entries) == []
    assert stale(entries | {"role/data": ("Kafka",)}) == ["1"]  # only who holds the word, in any case
    assert stale({k: v for k, v in entries.items() if not k.startswith("mode/")}) == ["4"]
    assert stale(entries, rules="2") == ["1", "2", "3", "4"]

    new = read([posting(1, "kafka streams"), posting(2, "backend service"), posting(3, "cooking", "Beta"), posting(5, "new one")])
    out = retagging.refresh_tags(first.table, first.marks, new, F.lit(DAY), entries)
    assert ids(out.stale) == ["2", "3", "5"] and ids(out.changed) == ["2", "5"] and ids(out.table) == ["1", "2", "3", "4", "5"]
    roles = {r["id"]: r["filter_facets"]["role_categories"] for r in out.table.collect()}
    assert roles["2"] == ["backend_engineer"] and roles["4"] == []
    assert sum(r["n_after"] for r in out.counts.collect()) > 0


def test_rebuilt_openings(spark):
    payloads = [
        {"id": "1"},
        {"id": "2", "company": "", "basic_info": {"title": "", "summary": "frontend", "salary_max": 15000}, "tags": [{"name": "old", "category": "role", "filterable": True}, {"name": "own", "category": "general"}, {"name": " "}], "filter_facets": {}},
        {"id": "3", "basic_info": {"title": "Vue"}, "filter_facets": {"role_categories": ["kept"]}, "skill_requirements": {"required": [{"name": "skill pending"}, {"name": " Go "}], "optional_groups": [{"skills": []}, {"group_name": " ", "skills": [{"name": "x"}]}]}},
    ]
    df = records.from_payload(spark.createDataFrame([(json.dumps(p),) for p in payloads] + [("broken",), (None,)], "payload string"), schemas.JOB)
    rows = {r["id"]: r.asDict(recursive=True) for r in normalize.rebuilt_openings(df, F.lit(DAY)).collect() if r["id"]}
    assert (rows["1"]["company"], rows["1"]["filter_facets"]["role_categories"], rows["1"]["tags"][0]["name"]) == ("Company Pending", [], "fulltime")
    two = rows["2"]
    assert two["filter_facets"]["role_categories"] == ["frontend_engineer"] and two["filter_facets"]["salary_band"] == "mid"
    assert [t["name"] for t in two["tags"]][:2] == ["own", "frontend_engineer"] and "old" not in [t["name"] for t in two["tags"]]
    three = rows["3"]
    assert three["filter_facets"]["role_categories"] == ["kept"] and [s["name"] for s in three["skill_requirements"]["required"]] == ["Go"]
    assert [(g["group_name"], g["min_required"]) for g in three["skill_requirements"]["optional_groups"]] == [("Optional Skills", 1)]


def test_import_counts(spark):
    t = lambda *r: spark.createDataFrame(r, "id string, v int, u string").select("id", "v", F.col("u").cast("timestamp").alias("updated_at"))
    store, jobs = t(("a", 1, "2026-01-01"), ("b", 1, "2026-01-01")), t(("b", 2, "2026-01-02"), ("b", 3, "2026-01-03"), ("c", 1, "2026-01-01"))
    table, counts = maintain.import_jobs(store, jobs)
    assert sorted((r["id"], r["v"]) for r in table.collect()) == [("a", 1), ("b", 3), ("c", 1)]
    assert {r["status"]: r["n"] for r in counts.collect()} == {"new": 1, "updated": 1, "kept": 1}
    assert sorted(r["id"] for r in maintain.import_jobs(store, jobs, replace=True)[0].collect()) == ["b", "c"]


def test_unescape(spark):
    cases = {r"C:\\new\\tab \101\r": "C:\\new\\tab A\r", r"a\nb\tc\bd\fe\vf": "a\nb\tc\bd\fe\vf", "\\x41\\x4g": "A\x04g", r"\q\.": "q.", "end\\": "end\\", r"\\101": r"\101", r"\1018\60": "A80", "简\\\\历": "简\\历", "": "", "\\\\\\n": "\\\n"}
    df = spark.createDataFrame(list(cases.items()), "a string, b string")
    assert df.select(dumps.unescape(F.col("a")).alias("x"), "b").filter("not x <=> b").collect() == []
    back = df.select(dumps.field(dumps.escape(F.col("b"))).alias("x"), "b").filter("not x <=> b")
    assert back.collect() == [] and spark.range(1).select(dumps.escape(F.lit(None).cast("string")).alias("x")).first()["x"] == r"\N"


def test_dump_of_many_tables(spark, tmp_path):
    """Blocks are known by their places: rows that look like headers, text between blocks, an unclosed last block, columns by header; in tiny splits too."""
    rows = [f"{i}\tname {i}\t{i / 2}" for i in range(400)]
    text = ["-- dump", "7\tnot a row\t1", "COPY public.a (id, name, amount) FROM stdin;", *rows[:150], "COPY public.b (id, name) FROM stdin;", "", *rows[150:], "\\.", "8\tneither\t1", "\\.", 'COPY public.b (amount, "id") FROM stdin;', *[f"{i}.5\t{i}" for i in range(300)], "\\.", "COPY public.c (id) FROM stdin;", "1", "\\N"]
    (tmp_path / "one.sql").write_text("\n".join(text))
    (tmp_path / "two.sql").write_text("COPY public.a (name, id) FROM stdin;\nzzz\t9999\n\\.\n")
    kind = {"id": "int", "name": "string", "amount": "double"}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        read = lambda t: sorted(map(tuple, dumps.read_dump_table(spark, str(tmp_path), t, kind).collect()), key=str)
        try:
            assert read("public.a") == sorted([*((i, f"name {i}", i / 2) for i in range(400)), (None, None, None), (9999, "zzz", None)], key=str)  # the header among the rows is one of them
            assert read("public.b") == sorted(((i, None, i + 0.5) for i in range(300)), key=str)
            assert read("public.c") == [(1, None, None), (None, None, None)]
            assert dumps.read_dump(spark, str(tmp_path), broadcast_blocks=0).count() == 704
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_jobs_of_a_dump(spark, tmp_path):
    tail = ["[1]", "[2]", "[3]"]
    a = ["11", "j11", "org", "Java开发", r"line one\nline two", "more", "Acme", "上海", "全职", "f", "10000", "20000", "12", "14", r"\N", r"\N", "CNY", "Sum", '["do this"]', '["good"]', *tail, "3.5", "本科", "2026-01-02 03:04:05.1+08", "2026-01-03 00:00:00+08", "board", "t"]
    b = ["12", r"\N", "org", "Go", "Beta", "北京", "intern", "t", r"\N", r"\N", r"\N", r"\N", "200", "day", r"\N", r"\N", *tail, "0", "硕士2026-01-02 03:04:05+08", r"\N", "x", "f"]
    short, typeless = ["short", "line"], ["13", *["x"] * 25]
    (tmp_path / "dump.sql").write_text("COPY talent.jobs (id) FROM stdin;\n" + "\n".join("\t".join(r) for r in (a, b, short, typeless)) + "\n\\.\nCOPY other (id) FROM stdin;\n" + "\t".join(a) + "\n\\.\n")
    got = {r["id"]: r for r in dumps.read_jobs_dump(spark, str(tmp_path), "talent.jobs").collect()}
    assert sorted(got) == ["11", "12"]
    x, y = got["11"], got["12"]
    assert (x["title"], x["description"], x["company"], x["location"], x["job_type"]) == ("Java开发", "line one\nline two\n\nmore", "Acme", "上海", "全职")
    assert (x["salary_min"], x["salary_months_max"], x["responsibilities"], x["highlights"], x["experience_years"], x["min_degree"], x["created_at"], x["jd_quality_passed"]) == (10000, 14, ["do this"], ["good"], 3.5, "bachelor", "2026-01-02 03:04:05.1+08", True)
    assert x["summary"] == "Sum\n\nline one\nline two\n\nmore"
    assert (y["title"], y["company"], y["location"], y["job_type"], y["intern_salary_amount"], y["salary_negotiable"], y["min_degree"], y["created_at"], y["job_id"]) == ("Go", "Beta", "北京", "intern", 200, True, "master", "2026-01-02 03:04:05+08", None)


def test_resume_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "big.txt").write_text("x" * 50)
    (tmp_path / "b.md").write_bytes("﻿hello".encode())
    (tmp_path / "gb.txt").write_bytes("简历".encode("gb18030"))
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "x.png").write_text("no")
    files = records.scan_resume_files(spark, str(tmp_path))
    good, bad = records.decode_text(files)
    assert {r["name"]: r["text"] for r in good.collect()} == {"big.txt": "x" * 50, "b.md": "hello", "gb.txt": "简历"}
    assert [r["name"] for r in bad.collect()] == ["empty.txt"]


def test_camel_json_and_payload(spark):
    df = spark.createDataFrame([("1", (2, [("a", None)]))], "job_id string, basic_info struct<salary_min: int, tag_list: array<struct<tag_name: string, none_here: string>>>")
    assert json.loads(records.to_json_camel(df).collect()[0]["json"]) == {"jobId": "1", "basicInfo": {"salaryMin": 2, "tagList": [{"tagName": "a"}]}}
    back = records.from_payload(spark.createDataFrame([("1", '{"n": 3, "s": 4}'), ("2", "broken")], "id string, payload string"), "n int, s string")
    assert sorted(map(tuple, back.collect())) == [("1", 3, "4"), ("2", None, None)]


def test_work_history(spark):
    text = "工作经历\n2020.3-2022.05 星辰科技有限公司 Java工程师\n2022年06-至今 Acme Inc 架构师\n2019.01 - 2019.12 云网络 开发\n教育 2015"
    df = spark.createDataFrame([("r", text)], "id string, raw_text string")
    inferred = normalize.work_from_text(df)
    rows = [tuple(r)[2:] for r in sorted(inferred.collect(), key=lambda r: r["pos"])]
    assert rows[0] == ("星辰科技有限公司", "Java工程师", "2020.03", "2022.05") and rows[1][2:] == ("2022.06", "至今")
    stored = spark.createDataFrame([("r", 0, None, "高级工程师", "2020.03", "2022.05"), ("r", 1, "Undated", None, None, None)], "id string, pos int, company_name string, title string, start_date string, end_date string")
    merged = [tuple(r)[2:] for r in sorted(normalize.merge_work(stored, inferred, F.lit(DAY)).collect(), key=lambda r: r["position"])]
    assert merged[0][3] == "至今" and merged[1][0] == "星辰科技有限公司" and merged[-1][0] == "Undated" and len(merged) == 4
    assert normalize.repaired_history(df, stored, F.lit(DAY)).count() == 1


def test_work_merge_against_lists(spark):
    """Filling by dates and by place, adding, and one row of equal dates, against a plain loop."""
    kind = "id string, pos int, company_name string, title string, start_date string, end_date string"
    own = [("a", 0, None, None, None, None), ("a", 1, "X", None, "2020.01", "2021.01"), ("a", 2, "Y", "dev", "2020.01", "2021.01"), ("a", 3, "", " ", "2018.01", None), ("a", 4, "Z", None, None, None), ("a", 5, None, None, None, None), ("b", 0, None, None, None, None)]
    read = [("a", 0, "P", "boss", "2022.01", "至今"), ("a", 3, "Q", "test", "2018.01", None), ("a", 5, "R", None, "2015.01", "2016.01"), ("c", 1, "S", None, "2010.01", "2011.01"), ("c", 2, "S", "T", "2010.01", "2011.01")]

    def plain(who):
        mine, found = [list(r[2:]) for r in own if r[0] == who], [list(r[2:]) for r in read if r[0] == who]
        mine = [[v.strip() or None if v else None for v in r] for r in mine]
        dates = {tuple(r[2:]): r for r in found}
        out = []
        for i, r in enumerate(mine):
            f = dates.get(tuple(r[2:])) if any(r[2:]) else found[i] if not any(r[:2]) and i < len(found) else None
            out.append([x or y for x, y in zip(r, f)] if f else r)
        out += [f for f in found if f[2:] not in [r[2:] for r in out]]
        best, undated = {}, [r for r in out if not any(r[2:])]
        for r in out:
            k = tuple(r[2:])
            if any(k) and (k not in best or sum(map(bool, r[:2])) > sum(map(bool, best[k][:2]))):
                best[k] = r
        return sorted(map(str, [*best.values(), *undated]))

    merged = normalize.merge_work(spark.createDataFrame(own, kind), spark.createDataFrame(read, kind), F.lit(DAY)).collect()
    for who in "abc":
        assert sorted(str(list(r)[2:]) for r in merged if r["id"] == who) == plain(who)


def test_work_section(spark):
    text = "教育背景\n2001.09-2005.06 某学校\n工作经历\n2020.3-2022.05 星辰科技有限公司\n2019.01-2019.12 nothing named\n项目经历\n2018.01-2018.06 开发"
    df = spark.createDataFrame([("r", text), ("s", "2018.01-2018.06 开发"), ("t", None), ("u", "")], "id string, raw_text string")
    rows = normalize.work_from_text(df).collect()
    assert sorted((r["id"], r["company_name"], r["title"]) for r in rows) == [("r", "星辰科技有限公司", None), ("s", None, "开发")]


def test_resume_defaults(spark):
    raw = {"id": "r", "basic_info": {"summary": "电话 13812345678 负责人", "current_city": "上海"}, "skills": [{"name": "Go", "years": 4}], "raw_text": "意向城市：北京\nremote LLM", "work_experiences": [{"company_name": "Acme", "title": "Backend Engineer", "start_date": "2020.01", "end_date": "2023.01"}]}
    from pyspark.sql import types as T

    df = spark.createDataFrame([(json.dumps([raw]),)], "j string").select(F.explode(F.from_json("j", T.ArrayType(spark.createDataFrame([], schemas.RESUME).schema))).alias("r")).select("r.*")
    row = normalize.display_summary(normalize.normalize_resumes(df, F.lit(DAY))).collect()[0]
    assert (row["years"], row["basic_info"]["current_title"], row["basic_info"]["current_company"]) == (3, "Backend Engineer", "Acme")
    f = row["filter_facets"]
    assert f["target_cities"] == ["上海", "北京"] and f["preferred_work_modes"] == ["remote"] and f["seniority_level"] == "lead" and f["ai_capabilities"] == ["llm"]
    assert "13812345678" not in row["display_summary"]


def test_hash_gated_refresh(spark):
    payloads = spark.createDataFrame([("jobs", "1", "a b"), ("jobs", "2", "c"), ("jobs", "3", "d")], "namespace string, item_id string, payload string")
    stored = payloads.filter("item_id <> '3'").select("namespace", "item_id", F.when(F.col("item_id") == "1", F.sha2("payload", 256)).otherwise("old").alias("payload_hash"))
    out = recall.refresh_vectors(payloads, stored, F.current_timestamp()).collect()
    assert sorted(r["item_id"] for r in out) == ["2", "3"] and all(len(r["vector"]) == 64 for r in out)


def test_seed_only_when_empty(spark):
    seeds = spark.range(30)
    assert maintain.seed_if_empty(seeds.limit(0), seeds).count() == 20 and maintain.seed_if_empty(spark.range(1), seeds).count() == 1


def stored(table):
    return sorted((r["id"], r["v"]) for r in table.read().collect())


def test_stream_of_upserts(spark, tmp_path):
    src, target, marks = (str(tmp_path / n) for n in ("in", "table", "marks"))
    schema = "id string, v int, updated_at timestamp, posted_at string"
    rows = lambda *r: spark.createDataFrame(r, "id string, v int, t string, posted_at string").withColumn("updated_at", F.col("t").cast("timestamp")).select("id", "v", "updated_at", "posted_at")
    table = SnapshotTable(spark, target, ["id"], buckets=4)

    def load():
        stream = S.stream_of_files(spark, src, schema, "parquet")
        S.stream_upserts(stream, table, marks, prepare=lambda b: S.fresh(b, F.lit(DAY))).awaitTermination()
        return sorted((r["id"], r["v"], r["posted_days_ago"]) for r in table.read().collect())

    rows(("a", 1, "2026-01-01", "2026-01-30"), ("b", 1, "2026-01-01", None)).coalesce(1).write.parquet(src)
    assert load() == [("a", 1, 1), ("b", 1, None)]
    rows(("a", 2, "2026-01-02", "2026-01-21"), ("a", 3, "2026-01-03", "2026-01-21"), ("c", 1, "2026-01-01", None)).coalesce(1).write.mode("append").parquet(src)
    assert load() == [("a", 3, 10), ("b", 1, None), ("c", 1, None)]
    rows(("a", 9, "2025-12-31", None), ("b", 2, "2026-01-01", None)).coalesce(1).write.mode("append").parquet(src)  # the first is late, the second as new as what is there
    assert load() == [("a", 3, 10), ("b", 2, None), ("c", 1, None)]
    assert table.versions() == [1, 2, 3]


def test_snapshots(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "id string, v int, t string").select("id", "v", F.col("t").cast("timestamp").alias("updated_at"))
    table = SnapshotTable(spark, str(tmp_path / "t"), ["id"], buckets=8)
    assert table.read() is None and table.versions() == [] and table.compact() is None
    assert table.commit(rows(*[(f"k{i}", i, "2026-01-01") for i in range(40)]), batch=0) == 1
    live = table.manifest()["live"]
    assert table.commit(rows(("k3", 100, "2026-02-01"), ("k4", -1, "2025-01-01"), ("new", 1, "2026-01-01")), batch=1) == 2
    assert table.commit(rows(("k3", 7, "2027-01-01")), batch=1) is None  # a repeat of batch 1
    assert table.commit(rows(("x", 1, "2026-01-01")).filter("v > 1")) is None
    want = sorted([*((f"k{i}", i) for i in range(40) if i != 3), ("k3", 100), ("new", 1)])
    assert stored(table) == want
    touched = [b for b, at in table.manifest()["live"].items() if live.get(b) != at]
    assert 1 <= len(touched) <= 3  # other buckets' files are the same

    held = table.read()  # a reader, while the table is compacted and changed
    assert table.compact(buckets=3) == 3 and table.manifest()["buckets"] == 3
    table.commit(rows(("k5", 55, "2026-03-01")).withColumn("more", F.lit("x")))
    assert sorted((r["id"], r["v"]) for r in held.collect()) == want
    assert sorted((r["id"], r["v"]) for r in table.read(2).collect()) == want and table.read(1).count() == 40
    assert {r["id"]: r["more"] for r in table.read().collect() if r["id"] in ("k5", "k6")} == {"k5": "x", "k6": None}
    now = stored(table)
    assert table.vacuum(keep=1) >= 2 and table.versions() == [4] and stored(table) == now

    other = SnapshotTable(spark, str(tmp_path / "t"), ["id"])
    other.manifest = lambda version=None, m=table.manifest(): m | {"version": 3}  # as read before commit 4
    with pytest.raises(RuntimeError, match="another commit"):
        other.commit(rows(("k1", 1, "2028-01-01")))
    assert stored(table) == now


def test_stream_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("x", "2026-01-01"), ("x", "2026-01-01"), ("y", "2026-01-01")], "c string, t string").withColumn("ts", F.col("t").cast("timestamp")).write.parquet(src)
    stream = S.without_repeats(S.stream_of_files(spark, src, "c string, t string, ts timestamp", "parquet"), "c", "ts")
    query = stream.writeStream.format("memory").queryName("repeats").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "m")).start()
    query.awaitTermination()
    assert sorted(r["c"] for r in spark.sql("select c from repeats").collect()) == ["x", "y"]
