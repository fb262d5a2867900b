"""Byte-level BPE encoding and decoding with the rank file of a public tokenizer.

Texts are cut by the tokenizer's pattern.  The distinct pieces that a task
has not met yet are grouped by length into padded matrices, one row a piece.
Each round every row merges its leftmost pair of minimum rank: pairs are looked
up in a hashed table, and the matrix is compacted by one column.  Rows without
a pair leave the matrix.  A piece over ``WIDTH`` bytes is a matrix of its own,
folded into rows of that width whose minima are kept: each round merges the
leftmost least pair of all rows and compacts the row that lost a cell, so a
round costs a row, not the piece, and any length is encoded alike.

Defined results: a null text is empty; an empty text has no tokens; a very long
text is encoded whole, its memory a small factor of its length; a null or repeated
key is carried through; an empty table gives an empty result; a column named like
a result is replaced, other columns are carried as they are.  Ids travel as
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quire.llm import tokens

WIDTH = 512
MATRIX_CELLS = 1 << 20
#: Bytes of pieces and their ids that a task remembers; beyond that it starts afresh.
CACHE_BYTES = 32_000_000
NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [found.get(i, b"") for i in range(max(found) + 1)]


class Codec:
    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.bytes_of = vocabulary
        self.rank = {t: i for i, t in enumerate(vocabulary) if t}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        self._pairs()

    def _pairs(self) -> None:
        """An open-addressing table from pairs of tokens to the rank of their join."""
        keys, values = [], []
        for i, t in enumerate(self.bytes_of):
            for k in range(1, len(t)):
                left, right = self.rank.get(t[:k]), self.rank.get(t[k:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(i)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        bits = max(4, int(2 * max(1, len(key)) - 1).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at = (tokens.mix(key) >> self.shift).astype(np.int64)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] == 2**64 - 1]
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.values[at[first]] = key[first], value[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            at[todo] = at[todo] + (self.keys[at[todo]] != 2**64 - 1) & self.mask

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the joins of pairs, NONE where there is none or either side is padding (-1)."""
        key = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        out = np.full(key.shape, NONE, np.int32).ravel()
        live = np.flatnonzero((left >= 0).ravel() & (right >= 0).ravel())
        key = key.ravel()[live]
        at = (tokens.mix(key) >> self.shift).astype(np.int64)
        while len(live):
            there = self.keys[at]
            hit = there == key
            out[live[hit]] = self.values[at[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            live, key, at = live[on], key[on], at[on] + 1 & self.mask
        return out.reshape(left.shape)

    def _matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Merges all pieces of one bucket of lengths, a row each."""
        width = max(map(len, pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        sizes = np.array([len(p) for p in pieces])
        ids[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.joined(ids[:, :-1], ids[:, 1:])
        out: list[bytes] = [b""] * len(pieces)
        rows = np.arange(len(pieces))
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            if (done := least == NONE).any():
                kept = ids[done] >= 0
                flat = ids[done][kept].astype("<u4").tobytes()
                cuts = [0, *(4 * kept.sum(axis=1).cumsum()).tolist()]
                for row, i, j in zip(rows[done].tolist(), cuts, cuts[1:]):
                    out[row] = flat[i:j]
                rows, ids, ranks, best, least = rows[~done], ids[~done], ranks[~done], best[~done], least[~done]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            ids[line, best] = least
            ids = np.where(np.arange(ids.shape[1] - 1) > best[:, None], ids[:, 1:], ids[:, :-1])
            ranks = np.where(np.arange(ranks.shape[1] - 1) >= best[:, None], ranks[:, 1:], ranks[:, :-1])
            if w := ranks.shape[1]:
                here = best < w
                ranks[line[here], best[here]] = self.joined(ids[line[here], best[here]], ids[line[here], best[here] + 1])
                here = best > 0
                ranks[line[here], best[here] - 1] = self.joined(ids[line[here], best[here] - 1], ids[line[here], best[here]])
        return out

    def _folded(self, piece: bytes) -> bytes:
        """Merges one long piece that lies over several rows of a matrix."""
        flat = self.single[np.frombuffer(piece, np.uint8)]
        n, rows = len(flat), -(-len(flat) // WIDTH)
        ids, ranks = np.full((rows, WIDTH), -1, np.int32), np.full((rows, WIDTH), NONE, np.int32)
        ids.reshape(-1)[:n] = flat
        ranks.reshape(-1)[: n - 1] = self.joined(flat[:-1], flat[1:])  # of each cell with the next, of a row's last with the next row's first
        size = [WIDTH] * (rows - 1) + [n - WIDTH * (rows - 1)]
        after, before = [*range(1, rows), -1], [*range(-1, rows - 1)]
        least = ranks.min(axis=1)
        bytes_of, rank = self.bytes_of, self.rank.get

        def renewed(i: int, j: int) -> None:
            """The rank of a cell with the next one."""
            k, at = (i, j + 1) if j + 1 < size[i] else (after[i], 0)
            ranks[i, j] = NONE if k < 0 else rank(bytes_of[ids[i, j]] + bytes_of[ids[k, at]], NONE)

        while True:
            i = int(least.argmin())
            if (best := least[i]) == NONE:
                break
            j = int(ranks[i].argmin())
            k, at = (i, j + 1) if j + 1 < size[i] else (after[i], 0)
            ids[i, j] = best
            end = size[k] - 1
            for cells, empty in ((ids[k], -1), (ranks[k], NONE)):
                cells[at:end] = cells[at + 1 : end + 1]
                cells[end] = empty
            size[k] = end
            if not end:
                after[before[k]] = after[k]
                if after[k] >= 0:
                    before[after[k]] = before[k]
            renewed(i, j)
            h, at = (i, j - 1) if j else (before[i], size[before[i]] - 1)
            if h >= 0:
                renewed(h, at)
            for x in {h, i, k} - {-1}:
                least[x] = ranks[x].min()
        return ids[ids >= 0].astype("<u4").tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces, all different, into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for text in pieces:
            raw = text.encode()
            if (whole := self.rank.get(raw)) is not None:
                self.cache[text] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTH:
                self.cache[text] = self._folded(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length() if len(raw) > 16 else len(raw) + 64, []).append((text, raw))
        for group in buckets.values():
            step = max(1, MATRIX_CELLS // max(len(raw) for _, raw in group))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                self.cache.update(zip((text for text, _ in part), self._matrix([raw for _, raw in part]), strict=True))
        self.held += sum(200 + 5 * len(p) for p in pieces)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        pieces = [self.split(t) for t in texts]
        self.learn(list({p for one in pieces for p in one if p not in self.cache}))
        get = self.cache.__getitem__
        return [b"".join(map(get, one)) for one in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _extended(docs: DataFrame, place: str, made: dict[str, Callable], most: int) -> DataFrame:
    """The table with binary columns made of one column's slices in order, each given the one before; columns of those names are replaced."""
    docs = docs.drop(*made)
    at = docs.columns.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [start() for start in made.values()]
        for batch in batches:
            for part in tokens.slices(batch, at, most):
                values, new = part.column(at), []
                for step in steps:
                    values = step(values)
                    new.append(values)
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *made])

    return docs.mapInArrow(tokens.tidied(run), StructType([*docs.schema.fields, *(StructField(c, BinaryType()) for c in made)]))


def _encoder(docs: DataFrame, vocabulary: list[bytes], pattern: str) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the size of the rank file

    def start() -> Callable[[pa.Array], pa.Array]:
        codec = Codec(shared.value, pattern)
        return lambda texts: pa.array(codec.encode(pc.fill_null(texts, "").to_pylist()), pa.binary())

    return start


def _decoder(docs: DataFrame, vocabulary: list[bytes]) -> Callable:
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start() -> Callable[[pa.Array], pa.Array]:
        get = shared.value.__getitem__
        return lambda ids: pa.array([b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in ids.to_pylist()], pa.binary())

    return start


def encode(docs: DataFrame, vocabulary: list[bytes], pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The table with a column of the text's ids (binary)."""
    return _extended(docs, text_col, {ids_col: _encoder(docs, vocabulary, pattern)}, tokens.SLICE_BYTES)


def decode(encoded: DataFrame, vocabulary: list[bytes], ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The table with a column of the decoded bytes."""
    return _extended(encoded, ids_col, {decoded_col: _decoder(encoded, vocabulary)}, 4 * tokens.SLICE_BYTES)


def recoded(docs: DataFrame, vocabulary: list[bytes], pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The table with the text's ids and the bytes that these ids decode to, in one pass of one worker."""
    return _extended(docs, text_col, {ids_col: _encoder(docs, vocabulary, pattern), decoded_col: _decoder(docs, vocabulary)}, tokens.SLICE_BYTES)


def round_trip(docs: DataFrame, vocabulary: list[bytes], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, from its ids and what they decode to."""
    both = recoded(docs.select("doc_id", "text"), vocabulary, pattern).drop("text")
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
