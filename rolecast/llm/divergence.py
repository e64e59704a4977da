"""How far sources of a language differ in their words: chi-square sums of all pairs of sources from a tree of term rows.

A term's row is what the sources of its language have of it. A pair of sources differs by the sum over all terms of
f(p, q), where most terms are absent from most sources. So the sum is taken as if no source had any term, corrected for
each count that isn't zero (a histogram of counts per source), and corrected again where both sources of a pair have the
term. The last part needs pairs within rows: rows are inserted into a frequent-pattern tree, sources in order, equal
beginnings on one path with a multiplicity, and each node meets each of its ancestors once for all rows that share them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, join_hot, map_batches

#: Terms: letters A-Z in either case and all beyond ASCII, in UTF-8.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
NOT_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
SCALE = 1_000_000_000
#: Entries of a task's counts, and nodes of its tree, before they are handed on; rows handed on at once.
ENTRIES = 500_000
NODES = 200_000
HANDED = 50_000
PIECE = 1 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of some ``PIECE`` bytes, cut where no term is."""
    start = 0
    while len(data) - start > PIECE:
        end = NOT_TERM.search(data, start + PIECE)
        if end is None:
            break
        yield data[start : end.start()]
        start = end.start()
    yield data[start:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's texts."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            for at in range(0, len(terms), HANDED):
                some = terms[at : at + HANDED]
                values = [pa.array(map(c.__getitem__, some), pa.int64(), size=len(some)) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.binary()).cast(pa.string()), *values], names)
        counts.clear()

    for batch in batches:
        for i in range(batch.num_rows):
            n, docs = counts.setdefault((batch[0][i].as_py(), batch[1][i].as_py()), (Counter(), Counter()))
            seen: set[bytes] = set()
            for piece in _pieces(batch[2][i].as_py().encode().lower()):  # lower-cases A-Z only, as these are bytes
                terms = TERM.findall(piece)
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) for n, _ in counts.values()) > ENTRIES:
            yield from rows()
    yield from rows()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact; null without terms."""
    return F.when(terms > 0, 1 + _quotient(F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + 1), total.cast("decimal(20,0)") + terms))


def _quotient(a: Column, b: Column) -> Column:
    """a div b in whole numbers."""
    return F.call_function("div", a, b)


def _f(p: Column, q: Column) -> Column:
    return _quotient((p - q) * (p - q), q)


def term_rows(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept terms: lang, term, total, row of (source, n)) and (lang, source) of all groups. Null text, lang and source are ''."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    found = map_batches(docs.select(whole("lang"), whole("source"), whole("text")), _count, "lang string, source string, term string, n long, docs long")
    found = found.repartition("lang", "term")  # tasks have summed; both groupings below need no other exchange
    sums = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
    return cut(by_term.filter(F.col("docs") >= least).drop("docs")), docs.select(whole("lang"), whole("source")).distinct()


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corrections of pairs from a tree of a task's rows (lang, path of (source, p, base), m); the rows come in order of their paths."""
    names: dict[tuple[str, str], int] = {}
    nodes: dict[tuple[int, int, int], int] = {}
    parent: list[int] = []
    who: list[int] = []
    share: list[int] = []
    base: list[int] = []
    times: list[int] = []

    def corrections() -> pa.RecordBatch:
        up, g, p, p0, m = (np.array(x, np.int64) for x in (parent, who, share, base, times))
        f = lambda a, b: (a - b) * (a - b) // b
        keys, high, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        node, above = np.arange(len(up)), up
        while len(node := node[above >= 0]):
            above = above[above >= 0]
            for a, b in ((node, above), (above, node)):
                value = m[node] * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
                keys, at = np.unique(np.concatenate([keys, g[a] * len(names) + g[b]]), return_inverse=True)
                parts = []
                for old, new in ((high, value >> 32), (low, value & 0xFFFFFFFF)):  # sums of halves can't overflow
                    total = np.zeros(len(keys), np.int64)
                    np.add.at(total, at, np.concatenate([old, new]))
                    parts.append(total)
                high, low = parts
            above = up[above]
        label = list(names)
        pairs = [(label[k // len(names)], label[k % len(names)], (int(h) << 32) + int(x)) for k, h, x in zip(keys.tolist(), high, low)]
        for x in (nodes, parent, who, share, base, times, names):
            x.clear()
        columns = [[a[0] for a, _, _ in pairs], [a[1] for a, _, _ in pairs], [b[1] for _, b, _ in pairs]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([Decimal(v) for _, _, v in pairs], pa.decimal128(38, 0))], ["lang", "source", "item", "value"])

    for batch in batches:
        for lang, path, m in zip(*(c.to_pylist() for c in batch.columns)):
            at = -1
            for x in path:
                name = names.setdefault((lang, x["source"]), len(names))
                key = (at, name, x["p"])
                at = nodes.get(key, -1)
                if at < 0:
                    at = nodes[key] = len(parent)
                    for column, value in ((parent, key[0]), (who, name), (share, x["p"]), (base, x["base"]), (times, 0)):
                        column.append(value)
                times[at] += m
            if len(parent) > NODES:
                yield corrections()
    if parent:
        yield corrections()


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of the language by how far they are, and the ``top`` terms that a source favours.

    Kept terms are those in ``least`` documents of the language or more. A group's share of a term is 1 + floor(10^9 (n + 1) /
    (N + V)); f(p, q) = floor((p - q)^2 / q) is summed over all V terms of the language for each other source (part pair),
    and taken against the language's share for terms of more than that share (part term). All in whole numbers.

    Null text, lang and source are ''; a group without terms has shares all the same; a language without kept terms gives
    pairs of value 0. Repeated documents count each time. No document: no row. Other columns of docs are ignored.
    A row holds as many counts as the language has sources, whose square the result has anyway.
    """
    terms, groups = term_rows(docs, least)
    flat = terms.select("lang", "term", "total", F.explode("row").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    sums = flat.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("rows"))
    vocabulary = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    known = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"))
    known = cut(known.withColumn("base", _share(F.lit(0), F.col("size"), F.col("v"))))
    entries = terms.agg(F.sum(F.size("row"))).first()[0] or 0

    keyed = flat.withColumn("key", F.struct("lang", "source"))
    shares = join_hot(keyed, known.select(F.struct("lang", "source").alias("key"), "size", "v", "lang_size", "base", F.col("rows").alias("hot")), "key", "hot", entries)
    shares = shares.select("lang", "source", "term", _share(F.col("n"), F.col("size"), F.col("v")).alias("p"), _share(F.col("total"), F.col("lang_size"), F.col("v")).alias("q"), "base")
    rows = cut(shares.groupBy("lang", "term", "q").agg(F.sort_array(F.collect_list(F.struct("source", "p", "base"))).alias("path")))

    others = known.groupBy("lang").agg(F.max("v").alias("v"), F.collect_list(F.struct("source", "base")).alias("all"))
    a, b = F.col("a"), F.col("b")
    pairs = others.select("lang", "v", "all", F.explode("all").alias("a")).select("lang", "v", "a", F.explode("all").alias("b")).filter("a.source <> b.source")
    whole = lambda c: c.cast("decimal(38,0)")
    plain = pairs.select("lang", a["source"].alias("source"), b["source"].alias("item"), whole(F.coalesce(F.col("v") * _f(a["base"], b["base"]), F.lit(0))).alias("value"))

    single = rows.select("lang", F.explode("path").alias("a")).groupBy("lang", "a").agg(F.count(F.lit(1)).alias("m"))
    counted = single.groupBy("lang").agg(F.count(F.lit(1)).alias("hot"))
    met = join_hot(single, others.select("lang", "all").join(counted, "lang"), "lang", "hot", single.count()).select("lang", "m", "a", F.explode("all").alias("b")).filter("a.source <> b.source")
    both = lambda g, h, value: F.struct(g.alias("source"), h.alias("item"), whole(F.col("m") * value).alias("value"))
    one = met.select("lang", F.explode(F.array(
        both(a["source"], b["source"], _f(a["p"], b["base"]) - _f(a["base"], b["base"])),
        both(b["source"], a["source"], _f(b["base"], a["p"]) - _f(b["base"], a["base"])),
    )).alias("x")).select("lang", "x.*")

    paths = rows.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m")).filter(F.size("path") > 1)
    sorted_paths = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    tree = map_batches(sorted_paths.select("lang", "path", "m"), _insert, "lang string, source string, item string, value decimal(38,0)")

    pair = plain.unionByName(one).unionByName(tree).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    favoured = rows.select("lang", "term", "q", F.explode("path").alias("a")).filter("a.p > q").select("lang", a["source"].alias("source"), F.col("term").alias("item"), _f(a["p"], F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pair, "pair").unionByName(ranked(favoured, "term").filter(F.col("rank") <= top))
