"""Hard negatives by inner product, exact, from R-trees packed by sort-tile-recursion.

Items are tiled over the cluster by quantiles of one coordinate after another (the upper levels of the tree), and each
tile is packed further in its task. A box bounds each coordinate's part of an inner product, so the sum of these bounds
is an interval for all items in it. A search takes boxes from a queue, best upper bound first, and leaves those outside
of all wanted score windows or strictly below the kth best so far.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import cut, join_hot

#: Items of a tile, anchors of a turn, items of a leaf, slabs a cut, tiles a cut of the upper levels.
BLOCK, TURN, LEAF, SLABS, FANOUT = 1024, 1024, 64, 4, 32
#: Rows from which the order of the coordinates is taken; it changes how tight the boxes are, never the result.
SAMPLE = 10_000
NO_ID = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


class Tree:
    """An R-tree of one tile: nodes with bounds of every coordinate and of the label; leaves are ranges of rows."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        spread = np.argsort(-np.ptp(vectors, axis=0).astype(float), kind="stable") if vectors.shape[1] else np.zeros(0, int)
        self.order: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.span: list[tuple[int, int]] = []
        self._keys = [labels, *(vectors[:, c] for c in spread[:16])]
        self._pack(np.arange(len(ids)), 0)
        at = np.concatenate(self.order)
        self.vectors, self.labels, self.ids, self.nulls = vectors[at], labels[at], ids[at], nulls[at]
        bounds = [(f(self.vectors[a:b], axis=0), f(self.labels[a:b])) for a, b in self.span for f in (np.min, np.max)]
        self.low, self.high = np.array([b[0] for b in bounds[::2]]), np.array([b[0] for b in bounds[1::2]])
        self.label_low, self.label_high = [b[1] for b in bounds[::2]], [b[1] for b in bounds[1::2]]

    def _pack(self, rows: np.ndarray, depth: int) -> int:
        """Slabs by the next coordinate, until a slab is a leaf; returns the node."""
        node, start = len(self.span), sum(map(len, self.order))
        self.span.append((start, start + len(rows)))
        self.children.append([])
        if len(rows) <= LEAF:
            self.order.append(rows)
            return node
        rows = rows[np.argsort(self._keys[depth % len(self._keys)][rows], kind="stable")]
        size = max(LEAF, -(-len(rows) // SLABS))
        size = -(-size // LEAF) * LEAF  # all leaves but the last of a slab are full
        for a in range(0, len(rows), size):
            self.children[node].append(self._pack(rows[a : a + size], depth + 1))
        return node

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner product of each anchor with the items of each node."""
        plus, minus = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return plus @ self.low.T + minus @ self.high.T, plus @ self.high.T + minus @ self.low.T


class Goal:
    """The best ``n`` scores within [low, high]; ties by id, null ids last."""

    def __init__(self, low, high, n: int) -> None:
        self.low, self.high, self.n, self.best = low, high, n, []

    @property
    def floor(self):
        """Less than this can't be wanted any more."""
        return max(self.low, -self.best[-1][0]) if len(self.best) == self.n else self.low

    def add(self, rows: list[tuple]) -> None:
        if found := [r for r in rows if self.low <= -r[0] <= self.high]:
            self.best = sorted(self.best + found)[: self.n]


def search(tree: Tree, anchor: np.ndarray, anchor_id, label, same: bool, goals: list[Goal], lower: np.ndarray, upper: np.ndarray) -> None:
    """Fills the goals with rows of the same label (not the anchor's id) or of others, best box first."""
    wanted = lambda i: tree.label_low[i] <= label <= tree.label_high[i] if same else not (tree.label_low[i] == tree.label_high[i] == label)
    useful = lambda i: wanted(i) and any(upper[i] >= g.floor and lower[i] <= g.high for g in goals)
    queue = [(-upper[0], 0)] if useful(0) else []
    most = max(g.high for g in goals)
    while queue:
        bound, node = heapq.heappop(queue)
        if -bound < min(g.floor for g in goals):
            break
        if tree.children[node]:
            for c in tree.children[node]:
                if useful(c):
                    heapq.heappush(queue, (-upper[c], c))
            continue
        a, b = tree.span[node]
        score = tree.vectors[a:b] @ anchor
        inside = (score >= min(g.floor for g in goals)) & (score <= most)
        inside &= (tree.labels[a:b] == label) & (tree.nulls[a:b] | (tree.ids[a:b] != anchor_id)) if same else tree.labels[a:b] != label
        if len(take := np.flatnonzero(inside)):
            rows = [(-int(score[i]), bool(tree.nulls[a + i]), int(tree.ids[a + i])) for i in take]
            for g in goals:
                g.add(rows)


def _matrix(vectors: pd.Series, width: int, whole: bool) -> np.ndarray:
    """Rows of whole numbers, zeros behind shorter ones: doubles where all sums are exact in them, else Python's integers."""
    m = np.zeros((len(vectors), width), dtype=object if whole else float)
    for i, v in enumerate(vectors):
        m[i, : len(v)] = [int(x) for x in v] if whole else v
    return m


def _long(x: int) -> int:
    return max(-(2**63), min(2**63 - 1, x))


def _searched(same: bool, n: int, window: tuple[int, int]):
    """A function of a tile's anchors and items that finds the best n of each anchor, or of each of its positives."""

    def run(anchors: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(anchors) and len(items):
            sizes = [len(v) for x in (anchors["v"], items["v"]) for v in x]
            most = max((max(abs(int(v.min())), abs(int(v.max()))) for x in (anchors["v"], items["v"]) for v in x if len(v)), default=0)
            whole = max(sizes) * most * most * 2 >= 2**53
            a, b = (_matrix(x["v"], max(sizes), whole) for x in (anchors, items))
            ids = items["id"].fillna(NO_ID).astype("int64").to_numpy()
            tree = Tree(b, items["label"].to_numpy(), ids, items["id"].isna().to_numpy())
            lower, upper = tree.bounds(a)
            for i, row in enumerate(anchors.itertuples(index=False)):
                if same:
                    goals = [Goal(-float("inf"), float("inf"), n)]
                else:
                    goals = [Goal(-(-window[0] * int(p) // window[1]), int(p), n) for p in row.scores]
                search(tree, a[i], row.id, row.label, same, goals, lower[i], upper[i])
                found += [(row.key, k + 1, None if null else x, _long(-s)) for k, g in enumerate(goals) for s, null, x in g.best]
        keys, goal, ids, scores = zip(*found) if found else ((), (), (), ())
        return pd.DataFrame({"key": pd.Series(keys, dtype="int64"), "goal": pd.Series(goal, dtype="int32"), "other": pd.array(list(ids), dtype="Int64"), "score": pd.Series(scores, dtype="int64")})

    return run


def tiled(items: DataFrame, block: int = BLOCK, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, int]:
    """items(id, label, v, salt) with tile and part, the parts of each tile, and how many tiles there may be.

    A level cuts each tile by quantiles of one coordinate, computed as a grouped aggregate.

    What quantiles can't split, as copies, is dealt over parts by the rows' hash, so no part has many more than ``block`` rows.
    """
    total = items.count()
    blocks = max(1, -(-total // block))
    levels = max(1, int(np.ceil(np.log(blocks) / np.log(fanout) - 1e-9)))
    each = max(1, int(np.ceil(blocks ** (1 / levels) - 1e-9)))
    sample = items.select(F.xxhash64("id", "v").alias("h"), "v").orderBy("h").limit(SAMPLE).toPandas()["v"]
    width = max((len(v) for v in sample), default=0)
    spread = np.argsort(-_matrix(sample, width, False).std(axis=0), kind="stable")[:levels] if width else np.zeros(0, int)
    now = items.withColumn("tile", F.col("salt") * 0)  # no literal, lest the first join be one without a key
    for c in [int(x) for x in spread] if blocks > 1 else []:
        x = F.coalesce(F.get("v", F.lit(c)), F.lit(0))
        edges = now.groupBy("tile").agg(F.percentile_approx(x, [i / each for i in range(1, each)], 1000).alias("edges"), F.count(F.lit(1)).alias("n"))
        met = join_hot(now, cut(edges), "tile", "n", total)
        now = cut(met.withColumn("tile", F.col("tile") * each + F.size(F.filter("edges", lambda e: e < x))).drop("edges"))
    sizes = cut(now.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).alias("parts")))
    dealt = join_hot(now, sizes, "tile", "n", total)
    return cut(dealt.withColumn("part", F.pmod(F.xxhash64("id", "v", "salt"), F.col("parts"))).drop("parts", "salt")), sizes.select("tile", "parts"), each ** max(levels, 1)


def hard_negatives(items: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), block: int = BLOCK, turn: int = TURN, fanout: int = FANOUT) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of items and anchors with id, label and v, whole numbers.

    An anchor's positives are its best items of the same label and another id; a positive's negatives are the anchor's best items
    of other labels whose score is between window[0] / window[1] of the positive's and the positive's. Higher scores first, ties
    by smaller id, null ids last. Rows are items one by one, so repeated items are found repeatedly; repeated anchors (id, label and
    v) are one. Anchors without an id and rows with a null label or v are left out. Of vectors of different lengths the common
    length counts. Scores beyond 64 bits are reported as the nearest that fits, but ordered as they are. No items: no rows.
    All results are exact: what isn't looked at can't be better.
    """
    columns = [F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v")]
    rows = cut(items.select(*columns).filter("label is not null and v is not null").withColumn("salt", F.monotonically_increasing_id()))
    asked = anchors.select(*columns).filter("id is not null and label is not null and v is not null").distinct().withColumn("key", F.xxhash64("id", "label", "v"))
    tiles, parts, many = tiled(rows, block, fanout)
    asked = cut(asked)
    turns = max(1, -(-asked.count() // turn))
    items_side = tiles.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))))

    def merged(left: DataFrame, same: bool, n: int) -> DataFrame:
        """The best n over all tiles; rank is their place."""
        sent = left.withColumn("turn", F.pmod(F.col("key"), F.lit(turns).cast("long"))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))
        sent = sent.join(parts, "tile").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        keys = ("tile", "part", "turn")
        found = sent.groupBy(*keys).cogroup(items_side.groupBy(*keys)).applyInPandas(_searched(same, n, window), "key long, goal int, other long, score long")
        place = F.row_number().over(W.partitionBy("key", "goal").orderBy(F.desc("score"), F.col("other").asc_nulls_last()))
        return found.withColumn("place", place).filter(F.col("place") <= n)

    best = cut(merged(asked, True, positives))
    goals = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", F.col("other").alias("id"), "score"))).alias("p"))
    wanted = cut(asked.join(goals, "key"))
    lost = merged(wanted.select("key", "id", "label", "v", F.transform("p", lambda x: x["score"]).alias("scores")), False, negatives)
    out = lost.join(wanted.select("key", F.col("id").alias("anchor_id"), "p"), "key").withColumn("x", F.element_at("p", F.col("goal")))
    return out.select("anchor_id", F.col("x.id").alias("positive_id"), F.col("place").alias("rank"), F.col("other").alias("negative_id"), F.col("x.score").alias("positive_score"), F.col("score").alias("negative_score"))
