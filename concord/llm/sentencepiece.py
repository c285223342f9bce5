"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

The text gets a leading space, every space becomes the marker U+2581, and the best path is the one with the highest sum
of the pieces' scores. A character that no piece covers costs the lowest score less ten and becomes its UTF-8 bytes'
pieces. No piece holds a marker after another character, so the best path of a text is made of the best paths of its
stretches (markers, then what follows up to the next marker), and equal stretches are solved once in a worker. A piece
set without that property is solved over whole texts.

Ties of the score go to the path whose last piece is longer. Nothing is trained: the pieces and scores come from a file.
A file whose scores are the ranks of a merge list (whole numbers, no two alike but the least) holds no log scores; sums of ranks would
shun every late piece, so a piece then gets the log probability that Zipf's law gives its rank (``zipf_scores``).

Defined cases: a null text encodes as null, an empty one as no pieces; texts of any length are whole; repeated rows get
a row each; other columns pass through, and an output name that is among them is refused; an empty table gives none. A
marker in the text itself decodes to a space; every other text decodes to itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .scratch import refuse_clash

MARK = "▁"
#: Stretches that a worker remembers from one slice of rows to the next.
CACHE = 400_000
#: Stretches longer than this (code points) are not remembered, so the memory is bounded in bytes too.
CACHE_CHARS = 64
#: Rows at a time in a worker, and stretches that are solved together.
ROWS = 128
PARTS = 20_000
#: A model of more pieces than this is refused: its trie goes to every executor.
MAX_PIECES = 1_000_000


class DoubleArray:
    """A trie over bytes: from state s by byte c to base[s] + c, if check[base[s] + c] is s. value[s]: a piece or -1."""

    def __init__(self, pieces: list[bytes]):
        self.base, self.check, self.value = [0], [-1], [-1]
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        keys = [pieces[i] for i in order]
        self._free = 1
        stack = [(0, 0, len(keys), 0)]
        while stack:
            state, lo, hi, depth = stack.pop()
            if len(keys[lo]) == depth:
                self.value[state] = order[lo]
                lo += 1
            if lo >= hi:
                continue
            kids: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                c, j = keys[i][depth], i
                while j < hi and keys[j][depth] == c:
                    j += 1
                kids.append((c, i, j))
                i = j
            base = self._place([c for c, _, _ in kids])
            self.base[state] = base
            for c, i, j in kids:
                self.check[base + c] = state
                stack.append((base + c, i, j, depth + 1))
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (self.base, self.check, self.value))

    def _place(self, codes: list[int]) -> int:
        """The first base at which all codes are free."""
        check, c0 = self.check, codes[0]
        at = max(self._free, c0 + 1)
        tries = 0
        while True:
            need = at - c0 + codes[-1] + 1
            if need > len(check):
                grow = need - len(check) + 256
                check.extend([-1] * grow)
                self.base.extend([0] * grow)
                self.value.extend([-1] * grow)
            if check[at] < 0 and all(check[at - c0 + c] < 0 for c in codes):
                break
            at += 1
            tries += 1
        if tries > 64 and len(codes) <= 2:
            self._free = max(self._free, at - 32)
        return at - c0


def zipf_scores(ranks: list[float], matched: list[bool]) -> list[float]:
    """Log probabilities of pieces from ranks, the best of which is the greatest number: -log(place) - log(sum of 1 / place)."""
    order = sorted((i for i, ok in enumerate(matched) if ok), key=lambda i: -ranks[i])
    out = [0.0] * len(ranks)
    whole = math.log(sum(1 / (n + 1) for n in range(len(order))) or 1.0)
    for n, i in enumerate(order):
        out[i] = -math.log(n + 1) - whole
    return out


@dataclass
class Model:
    """Pieces by id, scores, kinds and the trie of the pieces that text can match."""

    pieces: list[str]
    scores: list[float]
    matched: list[bool]
    byte_ids: list[int]
    unk: int
    trie: DoubleArray
    split: bool

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], matched: list[bool], byte_ids: list[int], unk: int) -> Model:
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"more than {MAX_PIECES} pieces")
        own = [i for i, m in enumerate(matched) if m and pieces[i]]
        trie = DoubleArray([pieces[i].encode() for i in own])
        ids = np.array([*own, -1], dtype=np.int32)
        trie.value = ids[trie.value]
        return cls(pieces, scores, matched, byte_ids, unk, trie, not any(MARK in pieces[i].lstrip(MARK) for i in own))

    @classmethod
    def load(cls, path: str) -> Model:
        """Reads a model file on the driver."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        pieces = [m.id_to_piece(i) for i in n]
        of = {p: i for i, p in enumerate(pieces)}
        byte_ids = [of.get(f"<0x{b:02X}>", -1) for b in range(256)]
        matched = [not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in n]
        scores = [m.get_score(i) for i in n]
        own = [x for x, ok in zip(scores, matched, strict=True) if ok]
        if len(own) > 1 and len(set(own)) + own.count(min(own)) == len(own) + 1 and all(x <= 0 and x == int(x) for x in own):
            scores = zipf_scores(scores, matched)
        return cls.of(pieces, scores, matched, byte_ids if min(byte_ids) >= 0 else [], m.unk_id())


class Encoder:
    """Viterbi search with a bounded memory of stretches."""

    def __init__(self, model: Model):
        self.m = model
        self.base, self.check, self.value = (x.tolist() for x in (model.trie.base, model.trie.check, model.trie.value))
        self.unk_score = min((s for s, ok in zip(model.scores, model.matched, strict=True) if ok), default=0.0) - 10.0
        self.scores = np.array([*model.scores, 0.0])
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, list[int]] = {}

    def viterbi(self, text: str) -> tuple[int, ...]:
        """Ids of the best path over the text as it stands."""
        data = text.encode()
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.m.scores
        size = len(check)
        best: list[float | None] = [None] * (n + 1)
        back = [(0, -1)] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here is None:  # inside a character
                continue
            width = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
            s, j, single = 0, i, False
            while j < n:
                t = base[s] + data[j]
                if t >= size or check[t] != s:
                    break
                s, j = t, j + 1
                if (v := value[s]) >= 0:
                    single = single or j - i == width
                    score = here + scores[v]
                    if best[j] is None or score > best[j]:
                        best[j], back[j] = score, (i, v)
            if not single:
                j, score = i + width, here + self.unk_score
                if best[j] is None or score > best[j]:
                    best[j], back[j] = score, (i, -1)
        out: list[int] = []
        while n:
            i, v = back[n]
            if v >= 0:
                out.append(v)
            elif self.m.byte_ids:
                out.extend(self.m.byte_ids[b] for b in reversed(data[i:n]))
            else:
                out.append(self.m.unk)
            n = i
        return tuple(reversed(out))

    def solve(self, parts: list[str]) -> list[list[int]]:
        """Ids of the best path of each of many stretches, all at once: the same search, a step for all of them at a time."""
        m, check, base, value = self.m, self.m.trie.check, self.m.trie.base, self.m.trie.value
        raw = [p.encode() for p in parts]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
        part = np.repeat(np.arange(len(raw)), sizes)
        end = np.repeat(starts + sizes, sizes)
        # Every piece that begins at a character: (where, its bytes, which), by walking the trie from all of them at once.
        first = np.flatnonzero((data & 0xC0) != 0x80)
        at, state, found = first, np.zeros(len(first), dtype=np.int64), []
        depth = 0
        while len(at):
            on = at + depth < end[at]
            at, state = at[on], state[on]
            to = base[state] + data[at + depth]
            on = to < len(check)
            on[on] = check[to[on]] == state[on]
            at, state = at[on], to[on].astype(np.int64)
            depth += 1
            which = value[state]
            hit = which >= 0
            found.append((at[hit], np.full(int(hit.sum()), depth), which[hit].astype(np.int64)))
        # A character that no piece covers alone becomes its bytes.
        lead = data[first]
        width = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        covered = np.zeros(len(data), dtype=np.int64)
        alone = np.zeros(len(data), dtype=bool)
        covered[first] = width
        for i, n, _ in found:
            alone[i[covered[i] == n]] = True
        bare = ~alone[first]
        found.append((first[bare], width[bare], np.full(int(bare.sum()), -1)))
        i, n, v = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.argsort(i - starts[part[i]], kind="stable")
        i, n, v = i[order], n[order], v[order]
        offset = i - starts[part[i]]
        score = np.where(v >= 0, self.scores[v], self.unk_score)
        # One place more than bytes for each stretch.
        source, target = i + part[i], i + part[i] + n
        best = np.full(len(data) + len(raw), -np.inf)
        back = np.full(len(best), -1, dtype=np.int64)
        best[starts + np.arange(len(raw))] = 0.0
        cuts = np.searchsorted(offset, np.arange(int(sizes.max()) + 1 if len(sizes) else 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            new, to = best[source[a:b]] + score[a:b], target[a:b]
            more = new > best[to]
            to = to[more]
            best[to] = new[more]
            back[to] = np.flatnonzero(more) + a
        own, here = np.arange(len(raw)), starts + sizes + np.arange(len(raw))
        owners, edges = [], []
        while len(own):
            e = back[here]
            on = e >= 0
            own, e = own[on], e[on]
            owners.append(own)
            edges.append(e)
            here = source[e]
        owner, edge = np.concatenate(owners[::-1]), np.concatenate(edges[::-1])
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        ids, counts = v[edge], np.bincount(owner, minlength=len(raw))
        out, whole, a = [], ids.tolist(), 0
        rare = np.zeros(len(raw), dtype=bool)
        rare[owner[ids < 0]] = True
        for k, c in enumerate(counts.tolist()):
            one = whole[a : a + c]
            if rare[k]:
                one = [y for x, e in zip(one, edge[a : a + c].tolist(), strict=True) for y in ([x] if x >= 0 else self._bytes(data[i[e] : i[e] + n[e]].tolist()))]
            out.append(one)
            a += c
        return out

    def _bytes(self, codes: list[int]) -> list[int]:
        return [self.m.byte_ids[b] for b in codes] if self.m.byte_ids else [self.m.unk]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of many texts; stretches that are not remembered are solved together."""
        known = self.known
        marked = [None if x is None else (" " + x).replace(" ", MARK) if x else "" for x in texts]
        if not self.m.split:
            return [None if x is None else list(self.viterbi(x)) for x in marked]
        rows = [None if x is None else self.cut.findall(x) for x in marked]
        fresh = list(set(chain.from_iterable(ps for ps in rows if ps)).difference(known))
        for k in range(0, len(fresh), PARTS):
            some = fresh[k : k + PARTS]
            known.update(zip(some, self.solve(some), strict=True))
        out = [None if ps is None else list(chain.from_iterable(map(known.__getitem__, ps))) for ps in rows]
        if len(known) > CACHE:
            known.clear()
        else:
            for p in fresh:
                if len(p) > CACHE_CHARS:
                    del known[p]
        return out


class Decoder:
    """The text of ids: pieces and bytes joined and read as UTF-8, markers back to spaces, without the leading one."""

    def __init__(self, model: Model):
        self.parts = {i: p.encode() if ok else b"" for i, (p, ok) in enumerate(zip(model.pieces, model.matched, strict=True))}
        self.parts |= {i: bytes([b]) for b, i in enumerate(model.byte_ids)}

    def decode(self, ids) -> str:
        text = b"".join(map(self.parts.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _shared(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)


def _with_columns(df: DataFrame, make, names: list[str], kinds: list) -> DataFrame:
    """``df`` with more columns, which ``make()`` computes from a slice of rows; few rows at a time bound the memory."""
    refuse_clash(df, names)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, *of(part)], names=schema.names)

    # Arrow functions take columns by name, and not every name can be written as one.
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def encode_column(df: DataFrame, model: Model, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of a text column and, if ``decoded`` names a column, the text that they decode to."""
    sent, at = _shared(df, model), df.columns.index(text)

    def make():
        enc = Encoder(sent.value)
        dec = Decoder(sent.value)

        def of(part: pa.RecordBatch) -> list[pa.Array]:
            ids = enc.encode_all(part.column(at).to_pylist())
            cols = [pa.array([None if x is None else np.array(x, dtype=np.int32) for x in ids], type=pa.list_(pa.int32()))]
            if decoded:
                cols.append(pa.array([None if x is None else dec.decode(x) for x in ids], type=pa.string()))
            return cols

        return of

    return _with_columns(df, make, [out, *[decoded] * bool(decoded)], [T.ArrayType(T.IntegerType()), *[T.StringType()] * bool(decoded)])


def decode_column(df: DataFrame, model: Model, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text of a column of ids."""
    sent, at = _shared(df, model), df.columns.index(ids)

    def make():
        dec = Decoder(sent.value)
        return lambda part: [pa.array([None if x is None else dec.decode(x) for x in part.column(at).to_pylist()], type=pa.string())]

    return _with_columns(df, make, [out], [T.StringType()])


def ids_digest(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the ids, decimal, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
