"""Order of results: ranking, greedy diversification, pages, per-group tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dictionaries import GENERIC_PATTERNS
from ..functions.text import contains_any


def ranked(pairs: DataFrame, *order: Column | str, by: str = "resume_id", name: str = "rank") -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)))


def rank_total(pairs: DataFrame) -> DataFrame:
    """By total, equal ones in order of recall."""
    return ranked(pairs, F.desc("total"), "recall_rank")


def rank_algorithm(pairs: DataFrame) -> DataFrame:
    return ranked(pairs, F.desc("total"), F.desc("vector"), "job_id")


def rank_external(scores: DataFrame) -> DataFrame:
    """By a given score, then its parts; less transition cost is better; null counts as 0."""
    z = lambda n: F.coalesce(n, F.lit(0.0))
    keys = [F.desc(z(n)) for n in ("score", "domain", "skill", "experience", "location", "education", "salary")] + [z("transition_cost"), F.col("job_id")]
    return ranked(scores, *keys)


def page(df: DataFrame, number: int, size: int = 8, rank: str = "rank", by: str = "resume_id") -> DataFrame:
    """Page ``number`` (from 1) of ranked rows with ``has_next``: one row more than the pages so far is looked at."""
    more = F.max(rank).over(W.partitionBy(by)) > number * size
    return df.filter(F.col(rank) <= number * size + 1).withColumn("has_next", more).filter(F.col(rank).between((number - 1) * size + 1, number * size))


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int | Column) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def generic_penalty(text: Column) -> Column:
    both = text.contains("软件开发工程师") & contains_any(text, ("前端", "后端", "测试"))
    return F.when(contains_any(text, GENERIC_PATTERNS), 0.03).when(both, 0.04).otherwise(0.0)


def diversify(pairs: DataFrame, k: int, by: str = "resume_id") -> DataFrame:
    """k rows for each person, one after another: the best total less what repeats those already taken.

    pairs: (by, job_id, total, rank, company, title, template, generic); ``rank`` is the order that decides ties. Fold
    over a person's recalled candidates, a bounded list: every open candidate counts what it shares with those taken, so
    a step looks at the open ones once, whatever the number taken.
    """
    item = F.struct("rank", "total", "company", "title", "template", F.coalesce("generic", F.lit(0.0)).alias("generic"), "job_id")
    rows = pairs.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items"))
    shared = {"companies": ("company",), "titles": ("title",), "templates": ("template",), "both": ("company", "title")}

    def score(o: Column) -> Column:
        x = o["item"]
        return x["total"] - F.when(o["both"] > 0, 0.05).otherwise(0.0) - o["companies"] * 0.04 - F.when(o["companies"] >= 3, 0.15).otherwise(0.0) - o["titles"] * 0.015 - o["templates"] * 0.08 - x["generic"]

    def step(state: Column, i: Column) -> Column:
        best = F.array_max(F.transform(state["open"], lambda o: F.struct(F.round(score(o), 9).alias("score"), (-o["item"]["rank"]).alias("order"), o["item"].alias("item"))))

        def take(t: Column) -> Column:
            left = F.filter(state["open"], lambda o: o["item"]["rank"] != t["item"]["rank"])
            counted = lambda o: F.struct(o["item"].alias("item"), *[(o[n] + F.when(_all(t["item"], o["item"], f), 1).otherwise(0)).alias(n) for n, f in shared.items()])
            return F.struct(F.transform(left, counted).alias("open"), F.concat(state["taken"], F.array(t["item"])).alias("taken"))

        return F.when(F.size(state["open"]) > 0, F.element_at(F.transform(F.array(best), take), 1)).otherwise(state)

    start = F.struct(F.transform("items", lambda x: F.struct(x.alias("item"), *[F.lit(0).alias(n) for n in shared])).alias("open"), F.filter("items", lambda x: F.lit(False)).alias("taken"))
    taken = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step)["taken"]
    return rows.select(by, F.posexplode(taken).alias("pos", "x")).select(by, (F.col("pos") + 1).alias("position"), "x.job_id", "x.total", "x.company", "x.title", "x.template")


def _all(t: Column, x: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & (t[f] == x[f])
    return out
