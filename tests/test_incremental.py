"""State carried over rounds and batches: pools that widen, files that arrive late, imports that count themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.operators import maintain, recall
from rolecast.storage import staged
from rolecast.streaming import incremental as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_pools_widen_for_those_who_lack(spark):
    rng = np.random.default_rng(5)
    side = lambda n, key: spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(n)], f"{key} long, vector array<double>")
    people, jobs = staged(side(12, "resume_id")), staged(side(150, "job_id"))
    rule = "CASE resume_id % 4 WHEN 0 THEN true WHEN 1 THEN job_id % 10 = 3 WHEN 2 THEN job_id < 3 ELSE false END"
    passes = lambda pairs: pairs.withColumn("passed", F.expr(rule))
    ranked = staged(passes(recall.top_n(people, jobs, 150)))
    want = recall.candidate_pool(ranked, 4, 4, F.lit(5))
    report = {}
    got = recall.widened_pool(people, recall.cells_of(jobs), passes, 4, 5, report=report)
    key = lambda df: sorted((r["resume_id"], r["job_id"], r["recall_rank"], r["pool_rank"], r["recall_n"]) for r in df.collect())
    assert key(got) == key(want) and {r[0] % 4 for r in key(got)} == {0, 1, 2}
    assert report["rounds"] == 6 and report["judged"] < 12 * 150  # 5, 10, 20, 40, 80, all
    assert recall.widened_pool(people.limit(0), jobs, passes, 4, 5).collect() == [] == recall.widened_pool(people, jobs.limit(0), passes, 4, 5).collect()


def test_late_files_correct_the_first(spark, tmp_path):
    batches = [
        [("same", 5, "b.txt"), ("same", 5, "B2.txt"), ("own", 9, "z.txt"), (None, 1, "n.txt")],
        [("same", 5, "b.txt"), ("same", 5, "A.txt"), ("late", 3, "q.txt"), ("own", 9, "z.txt")],
        [("same", 4, "x.txt"), ("late", 8, "a.txt"), ("own", 10, "a.txt"), ("own", 9, None)],
    ]
    schema = "content string, size long, name string, path string"
    with pytest.raises(ValueError, match="RocksDB"):
        S.first_files(S.stream_of_files(spark, str(tmp_path), schema, "parquet"), "content")
    seen = []
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for rows in batches:
            spark.createDataFrame([(*r, f"/in/{r[2]}") for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = S.first_files(S.stream_of_files(spark, str(tmp_path / "in"), schema, "parquet"), "content")
            take = lambda batch, _: seen.extend(batch.collect())
            query = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            ended = query.awaitTermination(60)
            query.stop()
            assert ended
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    last = {r["content_sha1"]: r for r in seen}
    every = spark.createDataFrame([(*r, "") for b in batches for r in b], schema).filter("content is not null and name is not null")
    want = maintain.first_of_content(every, F.col("content"), ["size", F.lower("name"), "name"]).collect()
    assert {(r["content_sha1"], r["size"], r["name"]) for r in last.values()} == {(r["content_sha1"], r["size"], r["name"]) for r in want}
    assert sorted((r["name"], r["corrects"] or "") for r in seen) == [("A.txt", "b.txt"), ("b.txt", ""), ("q.txt", ""), ("x.txt", "A.txt"), ("z.txt", "")]


@pytest.mark.parametrize("replace", [False, True])
def test_import_counts_as_it_is_written(spark, tmp_path, replace):
    store = spark.createDataFrame([("a", 1, "2024-01-01", "x"), ("b", 2, "2024-01-01", None), (None, 9, "2024-01-01", "y")], "id string, v int, updated_at string, only_old string")
    jobs = spark.createDataFrame([("b", 3, "2024-02-01", 1.0), ("b", 4, "2024-03-01", 2.0), ("c", 5, "2024-01-01", None)], "id string, v int, updated_at string, only_new double")
    store, jobs = (df.withColumn("updated_at", F.to_timestamp("updated_at")) for df in (store, jobs))
    counts = maintain.import_observed(store, jobs, lambda t: t.write.parquet(str(tmp_path / "t")), replace)
    table, plain = maintain.import_jobs(store, jobs, replace)
    assert counts == {r["status"]: r["n"] for r in plain.collect()}
    got = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, table.select(*got.columns).collect()))
