"""JSON arrays cut into blocks, against the json module over whole files."""

import json
import random

import pytest

from rolecast.sources.json_arrays import read_elements


@pytest.fixture
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, str(size)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind < 3:
        return "".join(rng.choice(['a', ',', '"', "\\", "[", "]", "{", "}", ":", "\n", "是", '","jobs":[', " "]) for _ in range(rng.randrange(12)))
    if kind < 5:
        return rng.choice([None, True, 1.5, -3, "", "jobs"])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["jobs", "a,b", "k", '"', "", "x:y"]) + rng.choice(["", str(i)]): value(rng, depth + 1) for i in range(rng.randrange(4))}


def elements(df):
    return [json.loads(r["text"]) for r in df.orderBy("path", "pos").collect()]


@pytest.mark.parametrize("size", [64, 1_000])
def test_blocks_anywhere(spark, tmp_path, small_blocks, size):
    rng = random.Random(size)
    lists = [[value(rng) for _ in range(n)] for n in (0, 1, 40, 40)] + [["x," * 500, {"k": ["y,}" * 300] * 3}, []]]
    for i, items in enumerate(lists):
        around = [{"before": value(rng), "jobs": items, "after": value(rng)}, {"jobs": items}, items][i % 3 if i else 2]
        (tmp_path / f"{i}.json").write_text(("﻿" if i == 2 else "") + json.dumps(around, ensure_ascii=bool(i % 2), indent=2 if i == 3 else None, separators=(",", ":") if i == 1 else None), encoding="utf-8")
    small_blocks(size)
    df = read_elements(spark, str(tmp_path))
    assert elements(df) == [x for items in lists for x in items]
    assert df.select("path", "pos").distinct().count() == sum(map(len, lists))


def test_a_large_list_without_lines_is_read_in_many_tasks(spark, tmp_path, small_blocks):
    items = [{"id": str(i), "title": f"Role, {i}", "summary": 'a "b", [c' * (i % 30), "skills": ["Go", "C,"]} for i in range(20_000)]
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": items}))
    small_blocks(1 << 17)
    df = read_elements(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path), lineSep=",").rdd.getNumPartitions() > 20
    assert elements(df) == items


def test_roots_and_torn_files(spark, tmp_path, small_blocks):
    small_blocks(16)
    bad = {"object": '{"other": [1, 2, 3]}', "nested": '{"a": {"jobs": [1, 2]}}', "text": '"jobs, and more"', "torn": '[{"id": "1"}, {"id": "2", "t": "x', "no list": '{"jobs": {"a": 1, "b": 2}}'}
    for name, text in bad.items():
        path = tmp_path / f"{name.replace(' ', '_')}.json"
        path.write_text(text)
        with pytest.raises(Exception, match="is expected|ends within|no list"):
            read_elements(spark, str(path)).collect()
    (tmp_path / "nothing.json").write_text("")
    assert read_elements(spark, str(tmp_path / "nothing.json")).collect() == []
