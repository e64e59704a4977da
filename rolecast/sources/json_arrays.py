"""JSON arrays read in several tasks a file, whatever their lines: the text source cuts files at commas, and states are carried over its blocks.

Two looks at the blocks of all files. The first finds, for a block that begins outside a string and for one that begins within, how it
ends; a fold over the few rows of a file then gives the true beginning of each block. The second emits elements, whole ones at once; those
that blocks cut are put together from their parts, at most two parts a block and one for each block between. A task holds one element at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged

#: A string, closed (and perhaps a key, with its colon) or not, or a bracket.
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)("(\s*:)?)?|[\[\]{}]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*("(\s*:)?)?', re.S)


@dataclass
class Place:
    """Where a reader stands: within a string or not, how deep, and at each depth which key came last and whether the wanted one ever came."""

    inside: bool
    depth: int = 0
    wanted: str = "jobs"
    last: dict[int, bool] = field(default_factory=dict)
    ever: dict[int, bool] = field(default_factory=dict)

    def key(self, is_wanted: bool) -> None:
        self.last[self.depth] = is_wanted
        self.ever[self.depth] = self.ever.get(self.depth, False) or is_wanted

    def brackets(self, piece: str) -> Iterator[re.Match]:
        """Brackets outside strings, each before the depth counts it; what stands between commas is a piece, so no escape is ever cut."""
        at = 0
        if self.inside:
            end = _STRING_END.match(piece)
            if not end[1]:
                return
            self.inside, at = False, end.end()
            if end[2]:
                self.key(False)  # the wanted key has no comma
        for m in _TOKEN.finditer(piece, at):
            if m[0][0] != '"':
                yield m
                self.depth += 1 if m[0] in "[{" else -1
            elif not m[2]:
                self.inside = True
                return
            elif m[3]:
                self.key(m[1] == self.wanted)


def _blocks(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(values of ``names``, pieces) of each block, in the order of the scan."""
    from itertools import groupby

    rows = (row for b in batches for row in zip(zip(*[b.column(n).to_pylist() for n in names]), b.column("value").to_pylist()))
    for key, group in groupby(rows, lambda r: r[0]):
        yield key, (piece for _, piece in group)


def _ends(wanted: str):
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("root", pa.string()), ("within", pa.bool_()), ("inside", pa.bool_()), ("depth", pa.int64()), ("depths", pa.list_(pa.int64())), ("last", pa.list_(pa.bool_())), ("ever", pa.list_(pa.bool_()))])

    def run(batches):
        for (path, block), pieces in _blocks(batches, ["path", "block"]):
            places, root = [Place(False, wanted=wanted), Place(True, wanted=wanted)], None
            for piece in pieces:
                root = piece.lstrip("﻿ \t\r\n")[:1] if root is None else root
                for p in places:
                    for _ in p.brackets(piece):
                        pass
            rows = [{"path": path, "block": block, "root": root, "within": w, "inside": p.inside, "depth": p.depth, "depths": list(p.last), "last": list(p.last.values()), "ever": [p.ever[d] for d in p.last]} for w, p in zip((False, True), places)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run, "path string, block long, root string, within boolean, inside boolean, depth long, depths array<long>, last array<boolean>, ever array<boolean>"


def _beginnings(blocks: pd.DataFrame) -> pd.DataFrame:
    """Of one file: the true state at the beginning of each block, and why the file can't be read, if so."""
    inside, depth, listed, seen, root, out = False, 0, False, False, None, []
    rows = {(r.block, r.within): r for r in blocks.itertuples()}
    for block in sorted(set(blocks["block"])):
        r = rows[block, inside]
        root = r.root if root is None else root
        out.append((r.path, block, root, inside, depth, listed))
        keys = {d: (last, ever) for d, last, ever in zip(r.depths, r.last, r.ever)}
        last, ever = keys.get(1 - depth, (listed, False))
        inside, depth, listed, seen = r.inside, depth + r.depth, bool(last), seen or bool(ever)
    error = None
    if root not in ("[", "{") or (root == "{" and not seen):
        error = "a list of openings, or an object with one under the wanted key, is expected"
    elif inside or depth:
        error = "the file ends within its list"
    return pd.DataFrame(out, columns=["path", "block", "root", "inside", "depth", "listed"]).assign(error=error)


def _parts(wanted: str):
    names = ["path", "block", "root", "inside", "depth", "listed", "error"]
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("head", pa.bool_()), ("done", pa.bool_()), ("text", pa.string())])

    def elements(key: tuple, pieces: Iterator[str]) -> Iterator[tuple]:
        path, block, root, inside, depth, listed, error = key
        if root is None or error is not None:
            raise ValueError(f"{path}: {error or 'files were cut otherwise than in the first look'}")
        base = 1 if root == "[" else 2
        at = Place(inside, depth, wanted, {1: listed})
        n, head, cur = -1, False, None
        for i, piece in enumerate(pieces):
            between = at.depth == base and not at.inside  # a comma there ends an element
            open_ = at.depth >= base and (base == 1 or at.last.get(1, False))
            if i and cur is not None:
                if between:
                    yield path, block, n, head, True, "".join(cur)
                else:
                    cur.append(",")
            if open_ and between:
                n, head, cur = n + 1, True, []
            elif open_ and not i:
                cur = []
            begin = 0
            for m in at.brackets(piece):
                if m[0] in "[{" and at.depth == base - 1 and (base == 1 or at.last.get(1, False)):
                    if m[0] != "[":
                        raise ValueError(f"{path}: the wanted key holds no list")
                    n, head, cur, begin = n + 1, True, [], m.end()
                elif m[0] in "]}" and at.depth == base and cur is not None:
                    cur.append(piece[begin : m.start()])
                    yield path, block, n, head, True, "".join(cur)
                    cur = None
            if cur is not None:
                cur.append(piece[begin:])
        if cur is not None:
            yield path, block, n, head, at.depth == base and not at.inside, "".join(cur)

    def run(batches):
        rows, size = [], 0
        for key, pieces in _blocks(batches, names):
            for row in elements(key, pieces):
                rows.append(row)
                size += len(row[-1])
                if len(rows) >= 1_000 or size >= 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run, "path string, block long, n long, head boolean, done boolean, text string"


def read_elements(spark: SparkSession, path: str, wanted: str = "jobs") -> DataFrame:
    """(path, pos, text): the elements of JSON files whose root is a list, or an object with a list under ``wanted``, each as its JSON text.

    ``pos`` grows with the place in the file but isn't dense. Blocks are of the size that ``spark.sql.files.maxPartitionBytes`` and the
    number of files give. Files of other roots, and files that end within their list, raise; a file of nothing has no elements, and
    neither has one with a single value under ``wanted``. The states of blocks, a row each, are broadcast.
    """
    pieces = spark.read.text(path, lineSep=",").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    ends = pieces.mapInArrow(*_ends(wanted))
    states = staged(ends.groupBy("path").applyInPandas(_beginnings, "path string, block long, root string, inside boolean, depth long, listed boolean, error string"))
    parts = staged(pieces.join(F.broadcast(states), ["path", "block"], "left").mapInArrow(*_parts(wanted)))
    place = (F.col("block") + F.col("n")).alias("pos")
    whole = parts.filter("head and done").select("path", place, "text")
    order = W.partitionBy("path").orderBy("block", "head")
    cut = parts.filter("not (head and done)").withColumn("owner", F.last(F.when(F.col("head"), F.col("block")), ignorenulls=True).over(order))
    ordered = F.array_sort(F.collect_list(F.struct("block", "head", "text")))
    glued = cut.groupBy("path", "owner").agg(F.max(F.when(F.col("head"), F.col("n"))).alias("n"), ordered.alias("parts"))
    glued = glued.select("path", (F.col("owner") + F.col("n")).alias("pos"), F.array_join(F.transform("parts", lambda p: p["text"]), ",").alias("text"))
    return whole.unionByName(glued).filter(F.col("text").rlike(r"\S"))
