"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi search.

At each byte the automaton moves once; its output links give every piece that ends there, and each relaxes the
best score of the prefix that ends there. A character that no piece spells alone costs more than any piece
and becomes byte tokens. How pieces score depends on the model:

* of a unigram model the greatest sum of the pieces' scores wins (the one found first among equals: the longest last piece);
* the scores of a model trained by merges (BPE) are ranks, whose sum means nothing. There a piece may follow another only if
  the merges, replayed over both, leave the two as they are; all else scores minus infinity. A row of pieces is what the merges give
  for a text if and only if each two neighbours are, so exactly one piece can end the best path at each place, and the ids are those
  of the library. Which pieces may be neighbours follows from when each was merged (``Neighbours``) and is kept for each pair met.

The arithmetic runs over all distinct stretches of a slice of texts at once, one byte position after another; the few
that are much longer than the rest are read one by one. Stretches end where no piece can reach across: before a space after
something else (unless some piece does cross there, in which case a text is one stretch), and around characters of no piece.

As in the library, a text gets a space in front and spaces are part of pieces. U+2581 in a text is not taken
for a space but spelled in bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches, text_slices
from .tokens import Words, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 1 << 20
_SPACE = "▁"
_AUTOMATA: dict[int, "Automaton"] = {}


class Vocabulary:
    """Pieces as bytes (a blank for the space mark), their scores, and the tokens of single bytes. Of a model trained by merges
    ``halves`` has of each piece the two that are merged into it last, itself twice for a character, -1 where the merges never give it."""

    def __init__(self, pieces: list[tuple[bytes, float]], ids: list[int], byte_ids: list[int], size: int, blank_first: bool, halves: np.ndarray | None = None) -> None:
        self.pieces, self.ids, self.byte_ids, self.size, self.blank_first, self.halves = pieces, ids, byte_ids, size, blank_first, halves
        self.key = hash((tuple(pieces), tuple(ids), tuple(byte_ids), halves is None))


def merged(symbols: list[bytes], score: dict[bytes, float]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """(what is left, the last two that were merged): neighbours are merged while they form a piece, the best score first,
    the leftmost of equals."""
    last = None
    while True:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            s = score.get(symbols[i] + symbols[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return symbols, last
        last = (symbols[at], symbols[at + 1])
        symbols = [*symbols[:at], last[0] + last[1], *symbols[at + 2 :]]


@lru_cache(maxsize=4)
def read_model(path: str = MODEL) -> Vocabulary:
    """From a .model file with byte pieces; read on the driver, sent with the tasks (half a megabyte)."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models that rewrite their input can't give it back")
    pieces, ids, byte_ids = [], [], [-1] * 256
    for i, p in enumerate(model.pieces):
        if p.type == proto.ModelProto.SentencePiece.NORMAL or p.type == proto.ModelProto.SentencePiece.USER_DEFINED:
            pieces.append((p.piece.replace(_SPACE, " ").encode(), float(p.score)))
            ids.append(i)
        elif p.type == proto.ModelProto.SentencePiece.BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
    if min(byte_ids) < 0:
        raise ValueError("the model has no token for some byte")
    kinds = proto.TrainerSpec.ModelType
    if model.trainer_spec.model_type not in (kinds.UNIGRAM, kinds.BPE):
        raise ValueError("the model is neither of merges nor of a unigram")
    halves = piece_halves(pieces) if model.trainer_spec.model_type == kinds.BPE else None
    return Vocabulary(pieces, ids, byte_ids, len(model.pieces), model.normalizer_spec.add_dummy_prefix, halves)


def piece_halves(pieces: list[tuple[bytes, float]]) -> np.ndarray:
    score, number = dict(pieces), {t: n for n, (t, _) in enumerate(pieces)}
    out = np.full((len(pieces), 2), -1, np.int32)
    for n, (text, _) in enumerate(pieces):
        chars = [c.encode() for c in text.decode()]
        left, last = merged(chars, score)
        if len(chars) == 1:
            out[n] = n
        elif len(left) == 1 and last[0] in number and last[1] in number:
            out[n] = number[last[0]], number[last[1]]
    return out


class Neighbours:
    """Which pieces may follow each other, for a model of merges.

    In time, by rank of score, the pieces x and y are built from their characters. What ends x at some time is a
    node of its right edge (x, its right half, that one's right half, ...), alive from its own merge until that of the node above;
    what begins y is one of y's left edge. If two such that are alive together form a piece, and its turn comes while they are, the merges don't leave
    x and y apart. Of equal turns the leftmost is first.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        halves, n = vocabulary.halves, len(vocabulary.pieces)
        self.n = np.int64(n)
        score = np.array([s for _, s in vocabulary.pieces])
        rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.usable = halves[:, 0] >= 0
        char = halves[:, 0] == np.arange(n)
        birth = np.where(char, -1, rank)
        number = {t: i for i, (t, _) in enumerate(vocabulary.pieces)}
        joins = [(number[t[:k]], number[t[k:]], rank[i]) for i, (t, _) in enumerate(vocabulary.pieces) for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        joins = np.array(joins, np.int64).reshape(-1, 3)
        order = np.argsort(joins[:, 0] * n + joins[:, 1], kind="stable")
        self.join, self.turn = (joins[:, 0] * n + joins[:, 1])[order], joins[order, 2]
        self.edges = [self._edge(halves, birth, char, side) for side in (1, 0)]
        self.known, self.fine = np.zeros(0, np.int64), np.zeros(0, bool)
        self.memo: dict[int, bool] = {}
        self.turns: dict[int, int] = {}
        self.paths: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def _edge(self, halves: np.ndarray, birth: np.ndarray, char: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, births, deaths) of each piece's right or left edge, from the whole piece down; -1 fills up."""
        node, death = np.where(self.usable, np.arange(len(halves)), -1), np.full(len(halves), 1 << 40)
        nodes, births, deaths = [], [], []
        while (node >= 0).any():
            nodes.append(node)
            births.append(np.where(node >= 0, birth[node], 0))
            deaths.append(death)
            death = births[-1]
            node = np.where((node >= 0) & ~char[node], halves[node, side], -1)
        return tuple(np.stack(x, 1) if x else np.zeros((len(halves), 0), np.int64) for x in (nodes, births, deaths))

    def compute(self, pairs: np.ndarray) -> np.ndarray:
        x, y = pairs // self.n, pairs % self.n
        (r, rb, rd), (l, lb, ld) = ([e[i] for e in edge] for edge, i in zip(self.edges, (x, y)))
        key = np.where((r[:, :, None] >= 0) & (l[:, None, :] >= 0), r[:, :, None] * self.n + l[:, None, :], -1)
        at = np.minimum(np.searchsorted(self.join, key), max(0, len(self.join) - 1))
        hit = self.join[at] == key if len(self.join) else np.zeros(key.shape, bool)
        turn = self.turn[at] if len(self.join) else key
        now = np.maximum(turn, np.maximum(rb[:, :, None], lb[:, None, :]))
        met = hit & (now < rd[:, :, None]) & ((now < ld[:, None, :]) | (turn == ld[:, None, :]))
        return self.usable[x] & self.usable[y] & ~met.any((1, 2))

    def ok(self, pairs: np.ndarray) -> np.ndarray:
        """Whether the pieces of x * n + y may follow each other."""
        at = np.minimum(np.searchsorted(self.known, pairs), max(0, len(self.known) - 1))
        hit = self.known[at] == pairs if len(self.known) else np.zeros(len(pairs), bool)
        if not hit.all():
            new = np.unique(pairs[~hit])
            place = np.searchsorted(self.known, new)
            fine = np.concatenate([self.compute(new[i : i + 4096]) for i in range(0, len(new), 4096)])
            self.known, self.fine = np.insert(self.known, place, new), np.insert(self.fine, place, fine)
            at = np.searchsorted(self.known, pairs)
        return self.fine[at]

    def one(self, x: int, y: int) -> bool:
        """The same for one pair."""
        key = x * int(self.n) + y
        if key not in self.memo:
            if not self.turns:
                self.turns = dict(zip(self.join.tolist(), self.turn.tolist()))
            self.memo[key] = bool(self.usable[x] and self.usable[y]) and not any(
                turn is not None and (now := max(turn, rb, lb)) < rd and (now < ld or turn == ld)
                for r, rb, rd in self._path(0, x) for l, lb, ld in self._path(1, y) for turn in (self.turns.get(r * int(self.n) + l),)
            )
        return self.memo[key]

    def _path(self, side: int, x: int) -> list[tuple[int, int, int]]:
        if (side, x) not in self.paths:
            self.paths[side, x] = [row for row in zip(*(e[x].tolist() for e in self.edges[side])) if row[0] >= 0]
        return self.paths[side, x]


class Automaton:
    """Dense goto table over bytes; for each state its longest piece that ends there, and the next shorter one."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for n, (text, _) in enumerate(vocabulary.pieces):
            at = 0
            for b in text:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    piece.append(-1)
                at = children[at][b]
            piece[at] = n
        n = len(children)
        self.goto = np.zeros((n, 256), np.int32)
        fail = np.zeros(n, np.int32)
        # link: the longest proper suffix that is a piece; first: the state itself if it is one, else the link
        self.piece, first, link = np.array(piece, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        level = [0]
        for b, c in children[0].items():
            self.goto[0, b] = c
        level = list(children[0].values())
        for s in level:
            first[s] = s if piece[s] >= 0 else 0
        while level:
            below = []
            for s in level:
                f = fail[s]
                self.goto[s] = self.goto[f]
                for b, c in children[s].items():
                    fail[c] = self.goto[f, b]
                    self.goto[s, b] = c
                    link[c] = first[fail[c]]
                    first[c] = c if piece[c] >= 0 else link[c]
                    below.append(c)
            level = below
        self.first, self.link = first, link
        self.length = np.array([len(t) for t, _ in vocabulary.pieces], np.int32)
        self.score = np.array([s for _, s in vocabulary.pieces])
        self.unknown = (self.score.min() if len(self.score) else 0.0) - 10.0
        self.ids = np.array(vocabulary.ids, np.int32)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        used = np.zeros(256, bool)
        for t, _ in vocabulary.pieces:
            used[list(t)] = True
        self.alone = ~used
        self.alone[0x80:] = False  # part of a longer character, which may well have pieces
        self.crossing = any(b" " in t.lstrip(b" ") for t, _ in vocabulary.pieces)
        self.neighbours = None if vocabulary.halves is None else Neighbours(vocabulary)
        self.endings: dict[int, list[tuple[int, int, float]]] = {}

    def ends(self, state: int) -> list[tuple[int, int, float]]:
        """(piece, length, score) of the pieces that end in a state, the longest first."""
        if state not in self.endings:
            out, at = [], int(self.first[state])
            while at > 0:
                p = int(self.piece[at])
                out.append((p, int(self.length[p]), float(self.score[p])))
                at = int(self.link[at])
            self.endings[state] = out
        return self.endings[state]


def automaton(vocabulary: Vocabulary) -> Automaton:
    if vocabulary.key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[vocabulary.key] = Automaton(vocabulary)
    return _AUTOMATA[vocabulary.key]


def with_blank(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank before every row that isn't empty."""
    full = np.diff(bounds) > 0
    new = bounds + np.concatenate([[0], np.cumsum(full)])
    out = np.full(int(new[-1]), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[new[:-1][full]] = False
    out[keep] = data
    return out, new


def stretches(data: np.ndarray, bounds: np.ndarray, a: Automaton) -> Words:
    """All stretches of the rows, as words without gaps."""
    begins = np.zeros(len(data), bool)
    if len(data):
        alone, blank = a.alone[data], data == 0x20
        begins |= alone
        begins[1:] |= alone[:-1]
        if not a.crossing:
            begins[1:] |= blank[1:] & ~blank[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data)).astype(start.dtype) if len(start) else start
    first = np.searchsorted(start, bounds)
    return Words(data, bounds, start, end, np.zeros(0, np.int64), first, data.astype(np.uint16) + 1)


#: Stretches longer than the rest that are read one by one, and the bytes that they have at least.
FEW, LONG = 64, 300


def viterbi(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): the tokens of each stretch data[start:end], one after another."""
    size = end - start
    longer = max(LONG, int(np.partition(size, -FEW)[-FEW]) if len(size) > FEW else 0)
    alone, rest = np.flatnonzero(size > longer), np.flatnonzero(size <= longer)
    ids, bounds = _lanes(data, start[rest], end[rest], a)
    if not len(alone):
        return ids, bounds
    found = [_one(data[start[i] : end[i]].tobytes(), a) for i in alone]
    where = np.empty(len(size), np.int64)
    where[rest], where[alone] = np.arange(len(rest)), len(rest) + np.arange(len(alone))
    return gather(np.concatenate([ids, *found]), np.concatenate([bounds, bounds[-1] + np.cumsum([len(x) for x in found])]), where)


def _one(text: bytes, a: Automaton) -> np.ndarray:
    """The tokens of one stretch, byte by byte."""
    n, goto, ends, near = len(text), a.goto, a.ends, a.neighbours
    best, back, width = [-math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    state = char = 0
    for t, byte in enumerate(text):
        if byte & 0xC0 != 0x80:
            char = t
        state = int(goto[state, byte])
        top, piece, broad, single = -math.inf, -1, 0, False
        for p, k, s in ends(state):
            single = single or k == t + 1 - char
            at = t + 1 - k
            if best[at] + s > top and (near is None or (near.usable[p] and (back[at] < 0 or near.one(back[at], p)))):
                top, piece, broad = best[at] + s, p, k
                if near is not None:
                    single = True
                    break
        if not single and (t + 1 == n or text[t + 1] & 0xC0 != 0x80) and best[char] + a.unknown > top:
            top, piece, broad = best[char] + a.unknown, -1, t + 1 - char
        best[t + 1], back[t + 1], width[t + 1] = top, piece, broad
    out: list[int] = []
    while n:
        out += [int(a.ids[back[n]])] if back[n] >= 0 else [int(a.byte_ids[b]) for b in reversed(text[n - width[n] : n])]
        n -= width[n]
    return np.array(out[::-1], np.int32)


def _lanes(data: np.ndarray, start: np.ndarray, end: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """The same for many stretches at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    off = np.concatenate([[0], np.cumsum(size + 1)])
    best, back = np.full(off[-1], -np.inf), np.full(off[-1], -1, np.int32)  # back: piece, or -1 an unknown character
    width = np.zeros(off[-1], np.int32)
    best[off[:-1]] = 0.0
    state, char = np.zeros(len(size), np.int32), np.zeros(len(size), np.int64)
    live = len(size)
    for t in range(int(size[0]) if len(size) else 0):
        while size[live - 1] <= t:
            live -= 1
        lane = slice(0, live)
        byte = data[start[lane] + t]
        char[lane] = np.where((byte & 0xC0) != 0x80, t, char[lane])
        last = np.ones(live, bool)  # the byte that ends its character
        more = size[lane] > t + 1
        last[more] = (data[start[lane][more] + t + 1] & 0xC0) != 0x80
        state[lane] = a.goto[state[lane], byte]
        place = off[:-1][lane] + t + 1
        top, piece, broad, single = np.full(live, -np.inf), np.full(live, -1, np.int32), np.zeros(live, np.int32), np.zeros(live, bool)
        at, out = np.arange(live), a.first[state[lane]]
        while True:
            some = out > 0
            if not some.any():
                break
            at, out = at[some], out[some]
            p = a.piece[out]
            n = a.length[p]
            single[at] |= n == t + 1 - char[at]
            s = best[place[at] - n] + a.score[p]
            more = s > top[at]
            if a.neighbours is not None:
                before = back[place[at] - n]
                more &= a.neighbours.usable[p]
                both = np.flatnonzero(more & (before >= 0))
                more[both] = a.neighbours.ok(before[both] * a.neighbours.n + p[both])
            top[at[more]], piece[at[more]], broad[at[more]] = s[more], p[more], n[more]
            out = a.link[out]
            if a.neighbours is not None:  # no other piece can end here
                single[at[more]] = True
                at, out = at[~more], out[~more]
        n = (t + 1 - char[lane]).astype(np.int32)
        s = best[place - n] + a.unknown
        use = last & ~single & (s > top)
        top[use], piece[use], broad[use] = s[use], -1, n[use]
        best[place], back[place], width[place] = top, piece, broad
    lanes, ends, tokens, widths = [], [], [], []
    lane, at = np.arange(len(size)), size.copy()
    while len(lane):
        place = off[lane] + at
        lanes.append(lane)
        ends.append(at)
        tokens.append(back[place])
        widths.append(width[place])
        at = at - width[place]
        keep = at > 0
        lane, at = lane[keep], at[keep]
    if not lanes:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    lanes, ends, tokens, widths = (np.concatenate(x) for x in (lanes, ends, tokens, widths))
    lanes = order[lanes]
    sort = np.lexsort((ends, lanes))
    lanes, ends, tokens, widths = lanes[sort], ends[sort], tokens[sort], widths[sort]
    count = np.where(tokens < 0, widths, 1)
    ids = np.repeat(a.ids[np.maximum(tokens, 0)] if len(a.ids) else np.zeros(len(tokens), np.int32), count)
    where = np.concatenate([[0], np.cumsum(count)])
    given = np.empty(len(size), np.int64)  # starts in the order given
    given[order] = start
    odd = np.flatnonzero(tokens < 0)
    n = count[odd]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # byte of its unknown character
    ids[np.repeat(where[odd], n) + step] = a.byte_ids[data[np.repeat(given[lanes[odd]] + ends[odd] - widths[odd], n) + step]]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(lanes, count, len(size)).astype(np.int64))])
    return ids, bounds


def gather(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values of the rows ``which`` one after another, their bounds)."""
    n = np.diff(bounds)[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(bounds[which] - ends[:-1], n) + np.arange(ends[-1])], ends


def encode_rows(texts: pa.Array, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of each text."""
    a = automaton(vocabulary)
    data, bounds = text_bytes(texts)
    if vocabulary.blank_first:
        data, bounds = with_blank(data, bounds)
    w = stretches(data, bounds, a)
    if not len(w.start):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    _, one, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    ids, ends = viterbi(data, w.start[one], w.end[one], a)
    ids, ends = gather(ids, ends, which)
    return ids, ends[w.first]


def decode_rows(ids: np.ndarray, bounds: np.ndarray, vocabulary: Vocabulary) -> list[str]:
    """Texts of token ids; tokens without text (control, unknown) give none. Bytes that aren't UTF-8 become U+FFFD."""
    table = [b""] * vocabulary.size
    for i, (t, _) in zip(vocabulary.ids, vocabulary.pieces):
        table[i] = t
    for b, i in enumerate(vocabulary.byte_ids):
        table[i] = bytes([b])
    flat = np.frombuffer(b"".join(table), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in table])])
    data, ends = gather(flat, at, ids)
    whole, cuts = data.tobytes(), ends[bounds].tolist()
    skip = 1 if vocabulary.blank_first else 0
    return [whole[s + (skip if whole[s : s + 1] == b" " else 0) : e].decode("utf-8", "replace") for s, e in zip(cuts[:-1], cuts[1:])]


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", model: str = MODEL, decoded_col: str | None = None) -> DataFrame:
    """docs with the tokens of every whole text in ``ids_col``; null stays null, an empty text has none.

    With ``decoded_col`` the tokens are decoded again in the same pass, for a check against the text. Columns of
    these names are replaced; all others, repeats of rows included, stay as they are.
    """
    vocabulary = read_model(model)
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)]
    more = [] if decoded_col is None else [decoded_col]
    text_at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(text_at), SLICE):
                part = batch.slice(a, z - a)
                ids, bounds = encode_rows(part.column(text_at), vocabulary)
                null = pa.array(np.append(part.column(text_at).is_null().to_numpy(zero_copy_only=False), False))
                offsets = pa.array(bounds.astype(np.int32), mask=null.to_numpy(zero_copy_only=False))
                new = [pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))]
                if more:
                    new.append(pa.array(decode_rows(ids, bounds, vocabulary), pa.string(), mask=null.to_numpy(zero_copy_only=False)[:-1]))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*(f.name for f in kept), ids_col, *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{ids_col}` array<int>" + "".join(f", `{c}` string" for c in more)
    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in kept]), run, schema)


def decode(docs: DataFrame, ids_col: str = "ids", text_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """docs with the text of the tokens in ``ids_col``; null stays null. A column named ``text_col`` is replaced."""
    vocabulary = read_model(model)
    kept = [f for f in docs.schema.fields if f.name != text_col]
    ids_at = [f.name for f in kept].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(ids_at)
                sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                texts = decode_rows(flat, np.concatenate([[0], np.cumsum(sizes)]), vocabulary)
                null = lists.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=null)], [*(f.name for f in kept), text_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return map_batches(docs.select(*[F.col(f"`{f.name}`") for f in kept]), run, f"{schema}, `{text_col}` string")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """id, n_tokens, ids_hash, round_trip: encoded, decoded, and compared, for each row of docs. Null has no tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    back = encode(rows, "text", "ids", model, "decoded")
    return back.select(
        F.col("id").alias(id_col), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )
