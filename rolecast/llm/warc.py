"""Fixity audit of WARC files by Merkle trees.

A record is known by its number and the digest of its bytes. All records of a number are one leaf: their count, their
bytes, and the sums of their digests' four quarters (a hash of a multiset, which combines before the shuffle, so that
a number with any share of all records is no group). Leaves stand in the order of their numbers. A node of
the next level covers ten of them and hashes, in order, each child's hash and its offset range within the node; so a
record that is lost changes the nodes above it and no others, though all that follows it moves. A file is a run of
1,000 numbers, hence a node of the third level.

Each replica's tree is built from its own manifest. Two trees are compared from the roots: where these are equal nothing
else is read; else the children of differing nodes are joined, level by level, and only they, until the differing
numbers are known. Only the records of these are then compared. What is reported grows with the damage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut

FANOUT = 10
FILE_LEVEL = 3
#: Differing nodes of a level that are sent to all tasks (24 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000


def record_bytes(number: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text; its UTF-8 bytes are the record."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(records: DataFrame, number_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(number, digest, length, copies): the index of an archive; equal records are one row with their number of copies.

    Records without a number are numbered -1. Null addresses and payloads are empty; other columns are never read.
    """
    raw = record_bytes(F.col(number_col), F.col(url_col).cast("string"), F.col(payload_col).cast("string"))
    rows = records.select(F.coalesce(F.col(number_col).cast("long"), F.lit(-1)).alias("number"), raw.alias("raw"))
    rows = rows.select("number", F.sha2("raw", 256).alias("digest"), F.octet_length("raw").cast("long").alias("length"))
    return cut(rows.groupBy("number", "digest", "length").agg(F.count(F.lit(1)).alias("copies")))


def leaves(records: DataFrame) -> DataFrame:
    """(node, bytes, h): one leaf for each number of a manifest."""
    quarter = lambda i: F.conv(F.substring("digest", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") * F.col("copies")
    sums = records.groupBy("number").agg(F.sum("copies").alias("n"), F.sum(F.col("length") * F.col("copies")).alias("bytes"), *[F.sum(quarter(i)).alias(f"q{i}") for i in range(4)])
    return sums.select(F.col("number").alias("node"), "bytes", F.sha2(F.concat_ws(":", "n", "bytes", *[f"q{i}" for i in range(4)]), 256).alias("h"))


def _ranges(children: Column) -> Column:
    """Of sorted (node, bytes, h): (node, offset within the parent, bytes, h)."""
    before = lambda x: F.aggregate(children, F.lit(0).cast("long"), lambda s, c: s + F.when(c["node"] < x["node"], c["bytes"]).otherwise(0))
    return F.transform(children, lambda x: F.struct(x["node"].alias("node"), before(x).alias("offset"), x["bytes"].alias("bytes"), x["h"].alias("h")))


def _up(level: DataFrame, parent: Column) -> DataFrame:
    """(node, bytes, h, children): the level above; a node has ``FANOUT`` children at most."""
    kids = level.groupBy(parent.alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "bytes", "h"))).alias("kids"))
    kids = kids.select("node", _ranges(F.col("kids")).alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(",", c["offset"].cast("string"), (c["offset"] + c["bytes"]).cast("string"), c["node"].cast("string"), c["h"])), "|")
    size = F.aggregate("children", F.lit(0).cast("long"), lambda s, c: s + c["bytes"])
    return kids.select("node", size.alias("bytes"), F.sha2(text, 256).alias("h"), "children")


def depth_of(*manifests: DataFrame, fanout: int = FANOUT) -> int:
    """Levels below the root of trees that hold all numbers of these manifests: the last has ``fanout`` nodes at most."""
    ends = [m.agg(F.min("number").alias("low"), F.max("number").alias("high")).first() for m in manifests]
    low, high = min((e["low"] for e in ends if e["low"] is not None), default=0), max((e["high"] for e in ends if e["high"] is not None), default=0)
    depth = 1
    while high // fanout**depth - low // fanout**depth >= fanout:
        depth += 1
    return depth


def merkle_tree(records: DataFrame, depth: int | None = None, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels over a manifest's leaves, each (node, bytes, h, children) in the shared folder, the root last.

    Level i, from 1, holds the nodes over ``fanout`` ** i numbers, up to ``depth``. An empty manifest has empty levels.
    """
    levels = [leaves(records)]
    for _ in range(depth or depth_of(records, fanout=fanout)):
        levels.append(cut(_up(levels[-1], F.floor(F.col("node") / fanout))))
    return [*levels[1:], cut(_up(levels[-1], F.lit(0).cast("long")))]


def _children(level: DataFrame, bad: DataFrame | None, few: bool, name: str, restart: bool) -> DataFrame:
    """(node, h, offset) of the children of the bad nodes in one replica; only these nodes of the level are read on."""
    if bad is None:  # below the root
        rows = level.select("children", F.lit(0).cast("long").alias("base"))
    else:
        mine = bad.select("node", F.lit(0).cast("long").alias("base") if restart else F.col(name).alias("base"))
        rows = level.select("node", "children").join(F.broadcast(mine) if few else mine, "node")
    each = rows.select("base", F.explode("children").alias("c"))
    return each.select(F.col("c.node").alias("node"), F.col("c.h").alias(f"h_{name}"), (F.coalesce("base", F.lit(0)) + F.col("c.offset")).alias(name))


def differing_numbers(a: list[DataFrame], b: list[DataFrame]) -> DataFrame | None:
    """(node, a, b): numbers whose leaves differ, with where their range begins in the file in each replica (null where it
    has none); None if the roots are equal."""
    roots = [level[-1].select("h").collect() for level in (a, b)]  # one row each at most
    if roots[0] == roots[1]:
        return None
    bad = None
    for i in range(len(a) - 1, -1, -1):
        few = bad is not None and bad.count() <= BROADCAST_NODES
        restart = i == FILE_LEVEL - 1  # the nodes of this level are files
        x, y = (_children(side[i], bad, few, name, restart) for side, name in ((a, "a"), (b, "b")))
        both = x.join(y, "node", "full")
        bad = cut(both.filter(~F.col("h_a").eqNullSafe(F.col("h_b"))).select("node", "a", "b"))
    return bad


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The records in which two manifests differ: number, file, status, copies, primary_offset, replica_offset,
    primary_length, replica_length.

    status: 'corrupt' where of a number exactly one record is lost and one is new, so other bytes in its place; else
    'missing' what only the primary has, 'extra' what only the replica has, one row for each different record with the
    number of its copies. The offsets are where the number's range begins in its file in each replica, null where a replica has
    no record of it. A record that merely moved, because another before it changed its length, is in order. Equal
    archives, and two empty ones, give no rows.
    """
    depth = depth_of(primary, replica, fanout=fanout)
    trees = [merkle_tree(m, depth, fanout) for m in (primary, replica)]
    bad = differing_numbers(*trees)
    if bad is None:
        bad = trees[0][0].limit(0).select("node", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    few = bad.count() <= BROADCAST_NODES
    at = bad.select(F.col("node").alias("number"), F.col("a").alias("primary_offset"), F.col("b").alias("replica_offset"))
    side = lambda r, n: r.select("number", "digest", F.col("length").alias(f"{n}_length"), F.col("copies").alias(n)).join(F.broadcast(at) if few else at, "number").withColumnsRenamed({c: f"{n}_{c}" for c in ("primary_offset", "replica_offset")})
    keys = ["number", "primary_offset", "replica_offset"]
    both = side(primary, "p").join(side(replica, "r"), ["number", "digest"], "full").select("number", *[F.coalesce(f"p_{k}", f"r_{k}").alias(k) for k in keys[1:]], "p_length", "r_length", (F.coalesce("p", F.lit(0)) - F.coalesce("r", F.lit(0))).alias("gap"))
    open_ = cut(both.filter("gap <> 0").withColumn("r_length", F.when(F.col("gap") < 0, F.col("r_length"))).withColumn("p_length", F.when(F.col("gap") > 0, F.col("p_length"))))
    lost, new = F.sum(F.greatest("gap", F.lit(0))), F.sum(F.greatest(-F.col("gap"), F.lit(0)))
    pairs = open_.groupBy(*keys).agg(lost.alias("lost"), new.alias("new"), F.max("p_length").alias("p_length"), F.max("r_length").alias("r_length")).filter("lost = 1 and new = 1")
    corrupt = pairs.select(*keys, F.lit("corrupt").alias("status"), F.lit(1).cast("long").alias("copies"), "p_length", "r_length")
    rest = open_.join(pairs.select("number"), "number", "left_anti")
    single = rest.select(*keys, F.when(F.col("gap") > 0, "missing").otherwise("extra").alias("status"), F.abs("gap").alias("copies"), "p_length", "r_length")
    return corrupt.unionByName(single).select(
        "number", F.floor(F.col("number") / fanout**FILE_LEVEL).alias("file"), "status", "copies", "primary_offset", "replica_offset", F.col("p_length").alias("primary_length"), F.col("r_length").alias("replica_length")
    )


def damaged_copy(pages: DataFrame) -> DataFrame:
    """A replica with known faults, derived from pages(page_id, url, html): some with one character changed, some
    cut short, some missing, some twice. What is changed follows from page_id alone."""
    n = F.col("page_id")
    changed = F.translate(F.col("html"), "t", "T")
    html = F.when(n % 101 == 7, changed).when(n % 307 == 11, F.expr("left(html, length(html) div 2)")).otherwise(F.col("html"))
    kept = pages.filter(F.coalesce(n % 997 != 3, F.lit(True))).select("page_id", "url", html.alias("html"))
    return kept.withColumn("times", F.explode(F.when(n % 503 == 9, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("times")
