"""Keeping stored tables: upserts, deletes, lookups, imports, refreshes. Each returns the table to write or the rows to report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, by an aggregate that combines before the shuffle: a key with any share of all rows
    is never sorted in one task. Columns are those of rows."""
    parts = F.struct(*[_ascending(o, i) for i, o in enumerate(order)])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.groupBy(*keys).agg(F.min_by(whole, parts).alias("__first")).select("__first.*")


def _ascending(order: Column | str | tuple, i: int) -> Column:
    """A key of the order for ``min``: a column, or (column, 'desc') for numbers and times, the latter with nulls last."""
    if not isinstance(order, tuple):
        return (F.col(order) if isinstance(order, str) else order).alias(f"k{i}")
    c = F.col(order[0]) if isinstance(order[0], str) else order[0]
    return F.struct(c.isNull().alias("none"), (-c).alias("value")).alias(f"k{i}")


def latest(rows: DataFrame, keys: list[str], ts: str = "updated_at", tie: list | None = None) -> DataFrame:
    """The newest row of each key."""
    when = F.col(ts)
    if rows.schema[ts].dataType.typeName() in ("timestamp", "timestamp_ntz"):
        when = F.unix_micros(when.cast("timestamp"))
    elif rows.schema[ts].dataType.typeName() == "date":
        when = F.unix_date(when)
    return first_by(rows, keys, [(when, "desc"), *(tie or [])])


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], ts: str = "updated_at", tie: list | None = None) -> DataFrame:
    """target with updates in: the newest update of a key replaces its row."""
    new = latest(updates, keys, ts, tie)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def list_latest(df: DataFrame, n: int, ts: str = "updated_at", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(ts), key).limit(n)


def delete_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys), keys, "left_anti")


def get(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def missing_ids(asked: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return asked.select(key).distinct().join(stored.select(key), key, "left_anti")


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in stores.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def first_of_content(files: DataFrame, content: Column, order: list) -> DataFrame:
    """Each different content once: the first in the given order; ``content_sha1`` is its key."""
    return first_by(files.withColumn("content_sha1", F.sha1(content)), ["content_sha1"], order)


def import_status(files: DataFrame, known_names: DataFrame, max_bytes: int = 800_000) -> DataFrame:
    """files(name, size, text) with ``content_sha1``, an id from it, and ``status``: existing, large, empty, duplicate or imported.

    Of equal contents among the files left, the first by size and name is imported; names are unique.
    """
    rows = files.join(known_names.select("name").distinct().withColumn("known", F.lit(True)), "name", "left")
    rows = rows.withColumn("content_sha1", F.sha1(F.coalesce("text", F.lit(""))))
    open_ = F.col("known").isNull() & (F.col("size") <= max_bytes) & (F.trim(F.coalesce("text", F.lit(""))) != "")
    rows = rows.withColumn("open", open_)
    firsts = rows.filter("open").groupBy("content_sha1").agg(F.min(F.struct("size", F.lower("name").alias("low"), "name")).alias("f")).select(F.col("f.name").alias("name"), F.lit(True).alias("is_first"))
    rows = rows.join(firsts, "name", "left")
    status = F.when(F.col("known"), "existing").when(F.col("size") > max_bytes, "large").when(~F.col("open"), "empty").when(F.col("is_first").isNull(), "duplicate").otherwise("imported")
    return rows.withColumns({"status": status, "id": F.concat(F.lit("resume-"), F.substring("content_sha1", 1, 12))}).drop("known", "open", "is_first")


def import_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(category, n_before, n_after) of two long tag tables."""
    n = lambda df, name: df.groupBy("category").agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n(before, "n_before").join(n(after, "n_after"), "category", "full").select("category", zero("n_before"), zero("n_after"))


def changed_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``after`` that differ from before in one of the columns, with the names of those that do."""
    old = before.select(key, *[F.col(c).alias(f"old_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in columns]))
    rows = after.join(old, key, "left").withColumn("changed", names)
    return rows.filter(F.size("changed") > 0).drop(*[f"old_{c}" for c in columns])


def seed_if_empty(store: DataFrame, seeds: DataFrame, most: int = 20, order: str = "id") -> DataFrame:
    """The store, or up to ``most`` seeds where it has no rows."""
    return seeds.orderBy(order).limit(most) if store.isEmpty() else store


def import_jobs(store: DataFrame, jobs: DataFrame, replace: bool = False, key: str = "id", ts: str = "updated_at") -> tuple[DataFrame, DataFrame]:
    """(table to write, counts) of a batch import: upserts, or a new table with ``replace``; counts of new, updated and kept rows."""
    new = latest(jobs, [key], ts)
    old = store.limit(0) if replace else store
    known = new.join(old.select(key), key, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    part = lambda df, name: df.select(F.lit(name).alias("status"), "n")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    counts = part(known, "updated").unionByName(part(count(new.join(old.select(key), key, "left_anti")), "new")).unionByName(part(count(delete_keys(old, new, [key])), "kept"))
    return upsert(old, new, [key], ts), counts


def import_observed(store: DataFrame, jobs: DataFrame, write: Callable[[DataFrame], None], replace: bool = False, key: str = "id", ts: str = "updated_at", tie: list | None = None) -> dict[str, int]:
    """The import of ``import_jobs`` in one pass: ``write`` gets the table, and the counts of new, updated and kept rows are gathered as it is written.

    The counts are metrics of the write's last stage, so ``write`` must run that table once and whole, and not into the files that it is read
    from. A stage that is run again in part after lost executors counts each partition once.
    """
    new = latest(jobs, [key], ts, tie)
    old = store.limit(0) if replace else store
    whole = lambda df, name: df.select(key, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    both = whole(old, "__old").join(whole(new, "__new"), key, "full")
    is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    value = lambda c: F.when(is_new, F.col("__new")[c] if c in new.columns else None).otherwise(F.col("__old")[c] if c in old.columns else None).alias(c)
    counts = Observation()
    n = lambda which, name: F.count(F.when(which, True)).alias(name)
    seen = both.observe(counts, n(is_new & ~is_old, "new"), n(is_new & is_old, "updated"), n(~is_new, "kept"))
    write(seen.select(*[value(c) for c in dict.fromkeys([*old.columns, *new.columns])]))
    return counts.get
