"""SimHash near-duplicates, joined by fuzzy keys from the binary Golay code.

A fingerprint has 64 bits: bit i is the majority of bit i over the XXH64 hashes of the text's shingles.
Two fingerprints link at ``radius`` = 4 or fewer differing bits. Candidates come from three segments of
22, 21 and 21 bits, each read as a word of the perfect [23, 12] Golay code, which has exactly one of 4096
codewords within distance 3 of any word. Pigeonhole over the segments, for e1 + e2 + e3 <= 4:

* a segment without error: its own bits are a key (3 rows a fingerprint);
* otherwise the errors are (1, 1, 1) or (1, 1, 2) in some order, so two segments have exactly one error.
  Words that differ in one bit have this in common: the codeword nearest to one is within distance 4 of the
  other, and no word has more than six codewords that near. So for each pair of segments, the key (nearest
  of the first, near of the second) meets the other's key (near of the first, nearest of the second). Each
  fingerprint emits both forms, about 5 rows each (at most 36 rows a fingerprint in all).

Fingerprints, not documents, are joined: exact copies and texts of equal fingerprint are merged before.
Keys are dealt by hash and sorted; a task reads one key's fingerprints after another, compares them in
blocks and puts out a spanning forest of the links it verified, never all pairs. A key with more than
``block`` fingerprints is not compared; its fingerprints go to ``midpoints`` instead, which links any two at
distance 4 or less through a value within distance 2 of both: exact, linear in their number, without groups
in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, join_hot, map_batches, text_slices
from .graph import components

#: Fixed values of the [23, 12] Golay code: its generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
RADIUS = 4
BLOCK = 4096


def _remainders(x: np.ndarray) -> np.ndarray:
    """Of 23-bit words modulo the generator."""
    x = x.astype(np.int64)
    for i in range(22, 10, -1):
        x = np.where(x >> i & 1, x ^ (GENERATOR << (i - 11)), x)
    return x


class Golay:
    """Nearest codeword of a 23-bit word, and all codewords within distance 4, by syndrome."""

    def __init__(self) -> None:
        bits = [1 << i for i in range(23)]
        patterns = [0, *bits]
        patterns += [bits[i] | bits[j] for i in range(23) for j in range(i)]
        patterns += [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
        self.error = np.zeros(2048, np.int64)
        self.error[_remainders(np.array(patterns))] = patterns  # perfect: each syndrome has one pattern
        flips = np.array([0, *bits], np.int64)
        # For each syndrome, what turns the word into each codeword that a word one bit away decodes to.
        syndromes = np.arange(2048)
        low = syndromes[:, None] ^ _remainders(flips)[None, :]
        turns = self.error[low] ^ flips[None, :]
        self.turns = [np.unique(t) for t in turns]
        most = max(map(len, self.turns))
        self.near = np.stack([np.concatenate([t, np.full(most - len(t), -1)]) for t in self.turns])

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (the upper 12 bits) of the one codeword within distance 3."""
        return (words ^ self.error[_remainders(words)]) >> 11

    def around(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, codeword index) for every codeword that a word at distance 1 or 0 may decode to: 1 or 6 a row."""
        turns = self.near[_remainders(words)]
        row, at = np.nonzero(turns >= 0)
        return row, (words[row] ^ turns[row, at]) >> 11


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def text_fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Of one text, plainly; the tests hold the vectorised form against it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g, seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _fingerprint_rows(texts: pa.Array, width: int, seed: int) -> np.ndarray:
    digest = xxhash.xxh64_digest
    out, count, sums = [], 0, np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = (text.as_py() or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            continue
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        n = max(1, len(words) - width + 1)
        starts = [0, *ends[: n - 1].tolist()]
        stops = (ends[-n:] - 1).tolist()
        out += [digest(flat[s:e], seed) for s, e in zip(starts, stops)]
        sums[i] = n
    bits = np.unpackbits(np.frombuffer(b"".join(out), np.uint8).reshape(-1, 8), axis=1)  # big-endian digests
    votes = np.zeros((len(texts), 64), np.int64)
    full = np.flatnonzero(sums)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sums[full])[:-1]])
        votes[full] = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * votes > sums[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number, of every whole text; null or no word: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, z in text_slices(texts):
                fp = _fingerprint_rows(texts.slice(a, z - a), width, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(fp)], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, fp long")


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): any two fingerprints at distance 4 or less share a key."""
    code, u = golay(), fp.view(np.uint64)
    parts = [(u >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys = [], []
    for i, p in enumerate(parts):
        rows.append(np.arange(len(u)))
        keys.append(p | i << 32)
    nearest = [code.nearest(p) for p in parts]
    around = [code.around(p) for p in parts]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        tag = n + 3 << 32
        row, c = around[j]
        rows.append(row)
        keys.append(nearest[i][row] << 12 | c | tag)
        row, c = around[i]
        rows.append(row)
        keys.append(c << 12 | nearest[j][row] | tag)
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    once = np.ones(len(row), bool)
    once[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[once], key[once]


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).slice(a, 20_000).to_numpy(zero_copy_only=False)
            row, key = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def forest(fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some fingerprints, by blocks of one row against the rest."""
    u = fp.view(np.uint64)
    left, here, there = np.ones(len(u), bool), [], []
    # Breadth first: a reached fingerprint is compared once with those not reached yet.
    for seed in range(len(u)):
        if not left[seed]:
            continue
        left[seed] = False
        todo = [seed]
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            hit = rest[np.bitwise_count(u[rest] ^ u[x]) <= radius]
            if len(hit):
                left[hit] = False
                here.append(np.full(len(hit), x))
                there.append(hit)
                todo += hit.tolist()
    if not here:
        return fp[:0], fp[:0]
    return fp[np.concatenate(here)], fp[np.concatenate(there)]


def _linker(block: int, radius: int):
    """Reads (key, fp) sorted by key; puts out links (a, b), and (fp, null) for the fingerprints of larger keys."""

    def pairs(fp: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        hit = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius]
        yield fp[hit], fp[hit + 1]
        for i in np.flatnonzero(sizes > 2):
            yield forest(fp[bounds[i] : bounds[i + 1]], radius)

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None  # over: a key known to be too large
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if over is not None:
                n = int(np.searchsorted(k, over, "right"))
                if n:
                    yield out(f[:n], None)
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                over = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            last = int(bounds[-2])  # the last key may go on in the next batch
            yield from _emit(key[:last], fp[:last], bounds[:-1])
            key, fp = key[last:], fp[last:]
            if len(key) > block:
                over = key[0]
                yield out(fp, None)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from _emit(key, fp, np.array([0, len(key)]))

    def _emit(key: np.ndarray, fp: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        for i in np.flatnonzero(sizes > block):
            yield out(fp[bounds[i] : bounds[i + 1]], None)
        keep = np.repeat((sizes <= block) & (sizes > 1), sizes)
        sizes = sizes[(sizes <= block) & (sizes > 1)]
        found = list(pairs(fp[keep], np.concatenate([[0], np.cumsum(sizes)])))
        a, b = (np.concatenate([x[i] for x in found]) if found else fp[:0] for i in (0, 1))
        if len(a):
            edges = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
            yield out(edges[:, 0], edges[:, 1])

    return run


def midpoints(fps: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints at distance 4 or less: both lie within distance 2 of some value.

    Each emits its 2081 values within distance 2; a value links all that emit it to their least. The least is
    taken by an aggregate that combines before the shuffle, so nothing here grows with a group.
    """
    bits = [1 << i for i in range(64)]
    masks = np.array([0, *bits, *(bits[i] | bits[j] for i in range(64) for j in range(i))], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 64):
                x = fp[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ masks).ravel()), pa.array(np.repeat(x, len(masks)))], ["mid", "fp"])

    spread = fps.mapInArrow(run, "mid long, fp long")
    least = spread.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).filter("b < top")
    return spread.join(least.select("mid", "b"), "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def link_fingerprints(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints at distance ``RADIUS`` or less, from distinct (fp)."""
    keyed = fps.select("fp").mapInArrow(_key_rows, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(_linker(block, RADIUS), "a long, b long"))
    links = found.filter("b is not null")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    return links if large.isEmpty() else links.unionByName(midpoints(large))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id (least id reachable over links, itself included).

    One row per row of ``docs``, repeated rows included; other columns are ignored. A null or empty text
    has fingerprint zero and links like any other. A row of null id takes part, but gives no component its
    id; a component of null ids only has a null component_id. An empty table gives no rows.

    A fingerprint with many texts, and a component with many fingerprints, are no groups (``join_hot``).
    """
    prints = cut(fingerprints(docs, id_col, text_col, width, seed))
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    rows, nodes = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    roots = cut(components(link_fingerprints(least, block)).select(F.col("node").alias("fp"), "root"))
    linked = least.join(roots, "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    named = join_hot(linked, names, "root", "m", nodes).select("fp", "component_id", "n")
    alone = least.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "n")
    by_fp = cut(named.unionByName(alone))
    return join_hot(prints, by_fp, "fp", "n", rows).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
