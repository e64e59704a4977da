"""The matching cases: small nested records, expectations about order, filters and bounds."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast import schemas
from rolecast.operators import gaps, recall
from rolecast.operators import skills as K
from rolecast.plans import engine

DAY = datetime.date(2026, 1, 31)


def job(id, title, summary="", company="Acme", location="上海", roles=(), modes=("onsite",), intern=False, years=(None, None), days=3, required=(), groups=(), bonus=(), core=(), degree=None, prefer=(), tags=(), pay=(None, None), negotiable=False):
    return {
        "id": id, "company": company,
        "basic_info": {"title": title, "location": location, "summary": summary, "salary_min": pay[0], "salary_max": pay[1], "salary_negotiable": negotiable},
        "skill_requirements": {"required": [{"name": n} if isinstance(n, str) else n for n in required], "optional_groups": list(groups), "bonus": [{"name": n, "weight": 1} for n in bonus]},
        "experience_requirements": {"core": list(core), "bonus": [], "min_total_years": years[0]},
        "education_constraints": {"min_degree": degree, "prefer_degrees": list(prefer), "required_majors": [], "preferred_majors": []},
        "tags": [{"name": n, "category": c} for n, c in tags],
        "filter_facets": {"role_categories": list(roles), "work_modes": list(modes), "is_internship": intern, "posted_days_ago": days, "min_experience_years": years[0], "max_experience_years": years[1]},
    }


def resume(id="r", title="Engineer", summary="", years=2, skills=(), degree="bachelor", tags=(), roles=(), city="上海", pay=(None, None), projects=(), text=""):
    return {
        "id": id, "basic_info": {"work_years": years, "current_city": city, "current_title": title, "summary": summary, "first_degree": degree}, "educations": [{"degree": degree, "major": "Computer Science"}], "work_experiences": [], "projects": list(projects),
        "skills": [{"name": n} for n in skills], "tags": [{"name": n, "category": c} for n, c in tags], "expected_salary": {"min": pay[0], "max": pay[1]}, "filter_facets": {"role_categories": list(roles)}, "raw_text": text,
    }


def table(spark, rows, ddl):
    """By from_json, so that records may leave fields out."""
    fields = T.ArrayType(spark.createDataFrame([], ddl).schema)
    return spark.createDataFrame([(json.dumps(rows),)], "j string").select(F.explode(F.from_json("j", fields)).alias("r")).select("r.*")


THREE = [
    dict(title="Hardware Engineer", roles=["hardware_engineer"], years=(2, 4)),
    dict(title="Embedded Engineer Intern", roles=["embedded_engineer"], intern=True, years=(0, 1)),
    dict(title="Frontend Engineer", roles=["frontend_engineer"], modes=["remote"], years=(1, 3), days=30),
]
LEFT, RIGHT = [("a", "tech"), ("b", "domain"), ("c", "industry")], [("x", "tech"), ("y", "domain"), ("z", "industry")]
#: case: (person, their wish or None, openings)
CASES = {
    "remote": (dict(years=2, roles=["frontend_engineer"]), (["frontend_engineer"], ["remote"], "all", 90, None, None), THREE),
    "intern": (dict(years=2), (["embedded_engineer", "hardware_engineer"], [], "intern", None, 0.0, 1.0), THREE),
    "spelling": (dict(years=2), (["Embedded_Engineer "], [], "INTERN", 7, None, 1.0), THREE),
    "fulltime": (dict(years=2, roles=["frontend_engineer"]), ([], [], "fulltime", None, None, None), THREE),
    "semantic": (dict(skills=["Prompt Engineering"], years=3), None, [dict(title="LLM Engineer", required=["Prompt Design"]), dict(title="Java Developer", required=["Java"])]),
    "bridge": (
        dict(title="前端工程师", projects=[{"name": "运营后台", "description": "基于 Vue 和 TypeScript 开发前端页面", "tech_stack": ["Vue3", "TypeScript"], "responsibilities": ["前端组件开发"]}]), None,
        [dict(title="前端开发 Vue", required=["Vue", "TypeScript", "JavaScript"], core=[{"type": "tech", "name": "Vue", "keywords": ["前端组件"]}])],
    ),
    "direction": (dict(roles=["frontend_engineer"], tags=LEFT), None, [dict(title="Web", roles=["frontend_engineer"], tags=RIGHT), dict(title="Server", roles=["backend_engineer"], tags=RIGHT), dict(title="Server", roles=["testing_engineer"], tags=LEFT[:1] + RIGHT)]),
    "degree": (dict(degree="master"), None, [dict(title="X", degree="bachelor")]),
    "overqualified": (dict(years=8, skills=["Java"]), None, [dict(title="Java Intern", intern=True), dict(title="2025届校招 Java", years=(0, 1)), dict(title="Senior Java Developer", years=(5, 10))]),
    "level": (dict(years=8, skills=["Java"]), None, [dict(title="Junior Java Developer", required=["Java"], years=(0, 2)), dict(title="Senior Java Developer", required=["Java"], years=(5, 10))]),
    "transition": (dict(title="Java 后端", years=8, skills=["Java", "MySQL", "Redis"]), None, [dict(title="Golang 后端", required=["Go"], years=(3, 10))]),
}


@pytest.fixture(scope="module")
def tables(spark):
    people = [resume(name, **cv) for name, (cv, _, _) in CASES.items()]
    jobs = [job(f"{name}-{i}", **j) for name, (_, _, js) in CASES.items() for i, j in enumerate(js)]
    wishes = [(name, *w) for name, (_, w, _) in CASES.items() if w]
    pairs = [(name, f"{name}-{i}", 0.9, i + 1) for name, (_, _, js) in CASES.items() for i in range(len(js))] + [("remote", "gone", 0.1, 9)]
    vectors = [("prompt engineering", [1.0, 0.0]), ("prompt design", [0.99, 0.01]), ("java", [0.0, 1.0])]
    return (
        spark.createDataFrame(pairs, "resume_id string, job_id string, vector double, recall_rank int"), table(spark, jobs, schemas.JOB), table(spark, people, schemas.RESUME), spark.createDataFrame(wishes, schemas.FILTERS),
        spark.createDataFrame(vectors, "norm string, vector array<double>"),
    )


@pytest.fixture(scope="module")
def scored(tables):
    rows = engine.score_pairs(*tables[:4], F.lit(DAY), skill_vectors=tables[4]).collect()
    out = {}
    for r in rows:
        out.setdefault(r["resume_id"], {})[r["job_id"].rpartition("-")[2]] = r
    return out


def passed(scored, case):
    return sorted(i for i, r in scored[case].items() if r["filter_reason"] == "passed" and r["status"] == "matched")


def test_requested_filters(scored):
    assert [passed(scored, c) for c in ("remote", "intern", "spelling", "fulltime")] == [["2"], ["1"], ["1"], ["0", "2"]]


def test_semantic_skill_match(scored):
    a, b = scored["semantic"]["0"], scored["semantic"]["1"]
    assert a["skill0"] > 0.5 > b["skill0"] and a["matched"] == ["Prompt Design"]


def test_project_text_bridges_experience(scored):
    assert scored["bridge"]["0"]["skill"] >= 0.6 and scored["bridge"]["0"]["experience"] >= 0.6


def test_direction_mismatch(scored):
    assert [scored["direction"][i]["filter_reason"] for i in "012"] == ["passed", "direction_mismatch", "passed"]


def test_education_counts_little_above_the_minimum(scored):
    assert 0.8 <= scored["degree"]["0"]["education"] < 0.9


def test_overqualified_for_entry(scored):
    assert passed(scored, "overqualified") == ["2"]


def test_level_penalty_orders_junior_below_senior(scored):
    low, high = scored["level"]["0"], scored["level"]["1"]
    assert all(low[n] < high[n] for n in ("level_fit", "total", "penalty_multiplier"))


def test_stack_transition(scored):
    row = scored["transition"]["0"]
    assert row["alignment"] == 0 and row["transition"] >= 0.55 and row["level_fit"] >= 0.9 and row["penalty_multiplier"] >= 0.45 and row["total"] >= 0.2


def test_missing_job_keeps_its_row(scored):
    assert scored["remote"]["gone"]["status"] == "job_missing"


def test_recommend_and_gap_use_the_same_filters(spark, tables):
    pairs, jobs, people, wishes, _ = tables
    one = pairs.filter("resume_id = 'spelling'")
    chosen = engine.recommend(one, jobs, people, wishes, F.lit(DAY), 3)
    matches = chosen.select("resume_id", F.col("position").alias("rank"), "title", "salary_max", F.col("min_years").alias("job_years"), "missing")
    report = gaps.gap_report(matches, spark.createDataFrame([("spelling", 0, 2)], "resume_id string, want_max int, years int")).collect()[0]
    assert report["baseline_roles"] == ["Embedded Engineer Intern"]


def test_frontend_foundations_are_inferred(spark):
    index = K.candidate_skill_index(table(spark, [resume(skills=["Vue.js", "ES6+"])], schemas.RESUME))
    rows = {r["norm"]: r["confidence"] for r in index.collect()}
    assert {"vue", "html", "css", "javascript"} <= set(rows) and rows["html"] < 1 and rows["vue"] == 1


def test_recall_blocks_agree_with_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    q, t = rng.normal(size=(23, 8)), rng.normal(size=(57, 8))
    t[5] = 0
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "resume_id long, vector array<double>")
    ts = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(t)], "job_id long, vector array<double>")
    norm = np.linalg.norm(t, axis=1)
    norm[norm == 0] = 1
    sim = np.round(q @ t.T / np.linalg.norm(q, axis=1)[:, None] / norm, 6)
    want = sorted((i, int(j), n + 1) for i in range(23) for n, j in enumerate(sorted(range(57), key=lambda j: (-sim[i, j], j))[:6]))
    assert sorted((r["resume_id"], r["job_id"], r["recall_rank"]) for r in recall.top_n(qs, ts, 6, block=10).collect()) == want
    assert recall.top_n(qs.limit(0), ts, 6).collect() == []


def test_cosine_of_unequal_lengths(spark):
    """The product over the common length by the sizes of whole vectors, the same in both ways of recall."""
    import numpy as np

    a, items = [3.0, 4.0], {1: [3.0, 4.0, 12.0], 2: [5.0], 3: [], 4: [0.0, 1.0]}
    want = {i: (sum(x * y for x, y in zip(a, v)) / (np.linalg.norm(a) * np.linalg.norm(v)) if any(v) else 0.0) for i, v in items.items()}
    qs = spark.createDataFrame([(7, a)], "resume_id long, vector array<double>")
    ts = spark.createDataFrame(list(items.items()), "job_id long, vector array<double>")
    for rows in (recall.top_n(qs, ts, 9), recall.top_n(qs, ts, 9, block=1), recall.pruned_top_n(qs, ts, 9, block=2)):
        assert {r["job_id"]: r["score"] for r in rows.collect()} == pytest.approx(want, abs=1e-6)
    pairs = qs.crossJoin(ts.withColumnRenamed("vector", "other"))
    assert {r["job_id"]: r["c"] for r in pairs.select("job_id", recall.cosine(F.col("vector"), F.col("other")).alias("c")).collect()} == pytest.approx(want, abs=1e-6)


def vectors(spark, q, t):
    side = lambda x, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")
    return side(q, "resume_id"), side(t, "job_id")


ranked = lambda rows: sorted((r["resume_id"], r["recall_rank"], r["job_id"], r["score"]) for r in rows.collect())


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_recall_is_whole_without_coalescing(spark, partitions):
    """10,000 items and 500 queries in many blocks: no row may depend on where shuffles put a block."""
    import numpy as np

    rng = np.random.default_rng(6)
    q, t = rng.normal(size=(500, 16)), rng.normal(size=(10_000, 16))
    qs, ts = vectors(spark, q, t)
    score = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (t / np.linalg.norm(t, axis=1)[:, None]).T, 6)
    want = sorted((i, r + 1, int(j)) for i in range(500) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:15]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for rows in (recall.top_n(qs, ts, 15, block=1000), recall.pruned_top_n(qs, ts, 15, block=1000)):
            assert [r[:3] for r in ranked(rows)] == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pruned_recall_reads_few_pairs_of_grouped_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    q, t = centres[rng.integers(0, 40, 80)] + 0.3 * rng.normal(size=(80, 16)), centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    t[:50] = t[0]  # ties, over cells' parts
    t[50] = 0
    qs, ts = vectors(spark, q, t)
    report = {}
    found = recall.pruned_top_n(qs, ts, 15, block=64, report=report)
    assert ranked(found) == ranked(recall.top_n(qs, ts, 15))
    assert report["all"] == 80 * 4000 and report["pairs"] < 0.3 * report["all"], report
    index = recall.cells_of(ts)
    assert index.sizes.sum() == 4000 and index.sizes[-1] == 1
    assert ranked(recall.pruned_top_n(qs, index, 15)) == ranked(found)


def test_pruned_recall_of_odd_vectors(spark):
    """Zero and null vectors, fewer items than asked for, other lengths, empty sides."""
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, -1.0, 5.0])], "resume_id long, vector array<double>")
    ts = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [-1.0]), (4, []), (5, [0.0, 0.0, 1.0])], "job_id long, vector array<double>")
    for n in (1, 3, 9):
        assert ranked(recall.pruned_top_n(qs, ts, n, block=1)) == ranked(recall.top_n(qs, ts, n))
    assert recall.pruned_top_n(qs.limit(0), ts, 6).collect() == [] == recall.pruned_top_n(qs, ts.limit(0), 6).collect()


def test_similarity_join_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 24)) * 3
    q, t = (centres[rng.integers(0, 30, n)] + 0.5 * rng.normal(size=(n, 24)) for n in (120, 2000))
    t[:40] = q[0]
    t[40] = q[1] = 0
    qs, ts = vectors(spark, q, t)
    norm = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    score = np.round(norm(q) @ norm(t).T, 6)
    for least, block in ((0.88, 4096), (0.88, 37), (0.3, 500)):
        report = {}
        found = {(r["resume_id"], r["job_id"]): r["score"] for r in recall.similar_pairs(qs, ts, least, "resume_id", "job_id", block=block, report=report).collect()}
        assert found == pytest.approx({(int(i), int(j)): score[i, j] for i, j in zip(*np.nonzero(score >= least))}, abs=1e-6)
        assert least < 0.5 or (len(found) > 1000 and report["pairs"] < 0.3 * report["all"]), report
    assert recall.similar_pairs(qs.limit(0), ts, 0.9, "resume_id", "job_id").collect() == [] == recall.similar_pairs(qs, ts.limit(0), 0.9, "resume_id", "job_id").collect()
    with pytest.raises(ValueError, match="above 0"):
        recall.similar_pairs(qs, ts, 0.0, "resume_id", "job_id")


def test_similarity_join_multiplies_out_few_pairs(monkeypatch):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    side = lambda n: pd.DataFrame({"id": range(n), "v": list(rng.normal(size=(n, 32)) * np.linspace(4, 0.2, 32))})
    a, b = side(300), side(400)
    done, einsum = [], np.einsum
    monkeypatch.setattr(recall.np, "einsum", lambda how, x, y: done.append(len(x)) or einsum(how, x, y))
    found = recall.alike(a, b, 0.7, "l", "r")
    want = np.round(recall.unit(a["v"], 32) @ recall.unit(b["v"], 32).T, 6) >= 0.7
    assert len(found) == want.sum() > 0 and sum(done) < 0.2 * want.size


def test_domain_vectors_count(spark, tables, scored):
    """Where domain terms don't meet, the cosine of the domain vectors decides."""
    one = tables[0].filter("resume_id = 'degree'")
    vectors = spark.createDataFrame([("resumes", "degree", [1.0, 0.0]), ("jobs", "degree-0", [0.8, 0.6])], "namespace string, item_id string, vector array<double>")
    plain, near = scored["degree"]["0"], engine.score_pairs(one, *tables[1:4], F.lit(DAY), domain_vectors=vectors).first()
    assert plain["domain"] == 0.5 and near["domain"] == pytest.approx(0.8) and near["total"] > plain["total"]
