"""Near duplicates by DartMinHash signatures, banded candidates and exact checks.

A document is the weighted set of its shingles of five lower-cased words: a shingle
weighs as much as it is often there, and similarity is weighted Jaccard, the sum of
the lesser weights over the sum of the greater ones.  DartMinHash
throws darts at each element's region: darts arrive in every unit of weight as a
Poisson process over ranks, from hashes of the element and the unit alone, so
documents that share an element see the same darts.  Only darts under a rank
bound of about k ln k expected darts in the whole document are made, each falls
on a hashed coordinate, and the earliest dart of a coordinate is its value; if a
coordinate stays empty, the bound is doubled.  The cost is one dart or so for
each shingle and k ln k for each document.

32 bands of 5 coordinates make candidates (a pair at similarity 0.8 shares no
band once in 3e5 pairs).  In each bucket all members are compared with the
bucket's hub, the member that meets most others, by the exact similarity of their
weighted sets; what is linked becomes one component.  Only members of
different components that have not been compared yet are compared further.  They
are dealt out anew by their rarest shingles (a prefix filter, which loses no pair of
the threshold), and compared with more pivots in each round, until no bucket holds
such a pair: no link is lost, a large group of copies costs one comparison a member
rather than all pairs, and texts that only share a common passage are not compared.

A text is known by the first 64 bits of its MD5, so exact copies are one node.

Defined results: a null text is an empty one; texts without words are linked to
byte-identical texts only; texts of fewer than five words have one shingle, all
their words; repeated rows fall in one class; the class of rows that all have
null keys is null; a very long text is one set, held whole by its task; an empty table gives an empty result; other columns are
carried by ``deduplicated`` as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.components import components, relabelled
from quire.llm.tables import stored


#: Slots of counts by which shingles are ordered.
SLOTS = 1 << 18


@dataclass(frozen=True)
class Params:
    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 5
    seed: int = 1


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words, all words if there are fewer, and the n + 1 offsets by document."""
    data, at = tokens.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    w = tokens.words(data, at)
    count = np.diff(w.first)
    runs = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    start = np.repeat(w.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    long = np.repeat(count >= n, runs)
    odd = tokens.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros(first[-1], np.uint64)
    for j in range(n):
        within = start[long] + j
        out[long] += w.hash[within] * odd[j]
    for k in np.flatnonzero((count > 0) & (count < n)):
        own = w.hash[w.first[k] : w.first[k + 1]]
        out[first[k]] = (own * odd[: len(own)]).sum(dtype=np.uint64)
    return tokens.mix(out), first


def weighted(shingled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each document in order, their offsets, and how often each is there."""
    if not len(shingled):
        return shingled, first, np.zeros(0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((shingled, doc))
    own, of = shingled[order], doc[order]
    begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (of[1:] != of[:-1])]))
    return own[begin], np.searchsorted(of[begin], np.arange(len(first))), np.diff(np.append(begin, len(own))).astype(float)


def unit_sets(shingled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets whose plain Jaccard similarity is the weighted one: a shingle's first, second, ... occurrence are different elements."""
    own, first, times = weighted(shingled, first)
    units = times.astype(np.int64)
    upto = np.cumsum(units)
    number = (np.arange(units.sum()) - np.repeat(upto - units, units)).astype(np.uint64)
    offsets = np.concatenate([[0], upto])[first]
    return np.where(number == 0, np.repeat(own, units), tokens.mix(np.repeat(own, units) + number * np.uint64(0xD6E8FEB86659FD93))), offsets


def dart_minhash(elements: np.ndarray, first: np.ndarray, k: int, seed: int = 1, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures (documents x k) of weighted sets; elements first[i]:first[i + 1] are document i's.

    Without weights each element weighs 1, however often it is there.  Documents
    without elements get zeros.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    base = tokens.mix(elements + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    room = np.ones(len(base))
    if weights is None:
        total = np.diff(first).astype(float)
    else:
        total = np.bincount(doc, weights, minlength=len(first) - 1)
        units = np.maximum(np.ceil(weights), 0).astype(np.int64)
        unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        room = np.minimum(np.repeat(weights, units) - unit, 1.0)
        base, doc = tokens.mix(np.repeat(base, units) + unit.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), np.repeat(doc, units)
    n = len(first) - 1
    bound = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n), where=total > 0)
    out = np.zeros((n, k), np.uint64)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[doc])
        key, place, limit, left = base[own], doc[own], bound[doc[own]], room[own]
        rank, turn = np.zeros(len(own)), 0
        slots, ranks, ids = [], [], []
        while len(key):
            turn += 1
            h = tokens.mix(key + np.uint64(turn * 0xA0761D6478BD642F & (1 << 64) - 1))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            live = np.flatnonzero(rank < limit)
            key, place, limit, left, rank, h = key[live], place[live], limit[live], left[live], rank[live], h[live]
            dart = tokens.mix(h ^ np.uint64(0x8EBC6AF09C88C6E3))
            slot = place * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            if weights is not None:  # a dart in the part of a unit that the weight doesn't fill misses
                hit = (tokens.mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53 < left
                slots.append(slot[hit]), ranks.append(rank[hit]), ids.append(dart[hit])
            else:
                slots.append(slot), ranks.append(rank), ids.append(dart)
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        out.reshape(-1)[slot[won]] = dart[won]
        todo &= np.isinf(best.reshape(n, k)).any(axis=1)
        bound[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    odd = tokens.mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    parts = (signatures.reshape(len(signatures), bands, rows) * odd).sum(axis=2, dtype=np.uint64)
    return tokens.mix(parts + tokens.mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)


def _node(raw: bytes) -> int:
    return int.from_bytes(hashlib.md5(raw).digest()[:8], "big", signed=True)


def node(text: Column) -> Column:
    """The number of a text, as ``_node`` has it."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16), 16, -10).cast("long")


def _sketches(docs: DataFrame, text_col: str, p: Params) -> DataFrame:
    """(node, bands) of the texts that have words; copies in one batch come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 0):
                texts = part.column(0).drop_null()
                texts = texts.take(pa.array(sorted({t: i for i, t in enumerate(texts.to_pylist())}.values()), pa.int64()))
                nodes = np.array([_node(t.encode()) for t in texts.to_pylist()], np.int64)
                own, first = shingles(texts, p.words)
                some = np.diff(first) > 0
                own, first, times = weighted(own, first)
                keys = band_keys(dart_minhash(own, first, p.bands * p.rows, p.seed, times), p.bands, p.rows)[some]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * p.bands, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), bands], ["node", "bands"])

    return docs.select(text_col).mapInArrow(tokens.tidied(run), "node long, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Of pairs (a, b) of nodes those whose texts' weighted shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, (2, 3)):
                (x, fx), (y, fy) = (unit_sets(*shingles(part.column(k), p.words)) for k in (2, 3))
                good = np.zeros(len(part), bool)
                for i in range(len(part)):
                    u, v = x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]]
                    if p.threshold * max(len(u), len(v)) <= min(len(u), len(v)) + 1e-9:
                        both = len(np.intersect1d(u, v, assume_unique=True))
                        good[i] = both >= p.threshold * (len(u) + len(v) - both) - 1e-9
                yield part.select(["a", "b"]).filter(pa.array(good))

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(tokens.tidied(run), "a long, b long")


def _prefixes(texts: DataFrame, p: Params) -> DataFrame:
    """(bucket, node, size, place): the rarest shingles of each text, enough that similar texts share one.

    Of a set of n, those are n - ceil(threshold * n) + 1 in any order that all texts
    agree on.  The order is by counts in SLOTS hashed slots, then by hash, so shingles
    of a passage that many texts hold come last.
    """
    shift = np.uint64(64 - SLOTS.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in tokens.slices(batch, 0):
                total += np.bincount((unit_sets(*shingles(part.column(0), p.words))[0] >> shift).astype(np.int64), minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    counted = texts.select("text").mapInArrow(tokens.tidied(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    often = np.zeros(SLOTS, np.int64)
    often[counted["slot"].to_numpy()] = counted["n"].to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                own, first = unit_sets(*shingles(part.column(1), p.words))
                kept, size, total = [], [], []
                for i in range(len(part)):
                    u = own[first[i] : first[i + 1]]
                    n = len(u) - int(np.ceil(p.threshold * len(u) - 1e-9)) + 1
                    kept.append(u[np.lexsort((u, often[(u >> shift).astype(np.int64)]))[:n]])
                    size.append(len(kept[-1]))
                    total.append(len(u))
                place = np.concatenate([np.arange(1, n + 1) for n in size])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), size)), pa.array(np.repeat(total, size)), pa.array(place)], ["bucket", "node", "size", "place"])

    return texts.select("node", "text").mapInArrow(tokens.tidied(run), "bucket long, node long, size long, place long")


def _weighted(members: DataFrame) -> DataFrame:
    """Adds met: how many others a text meets. The original of many copies meets most of them."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    return stored(members.join(members.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("met")), "node"))


def classes(docs: DataFrame, p: Params = Params(), text_col: str = "text") -> DataFrame:
    """(node, root) of every text that is linked to a different one."""
    sketches = stored(_sketches(docs, text_col, p))
    members = sketches.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("bucket")
    members = stored(members.join(shared, "bucket").distinct())
    texts = docs.select(node(F.col(text_col)).alias("node"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    texts = stored(texts.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")))
    labels = stored(members.select("node", F.col("node").alias("root")).limit(0))
    tested = stored(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    open_members, pivots, banded = _weighted(members.select("*", F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("place"))), 1, True
    while True:
        rooted = open_members.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("bucket", "node", "met", "size", "place", F.coalesce("root", "node").alias("root"))
        mixed = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.max_by("node", F.struct("met", "node")).alias("hub")).where("low <> high").select("bucket", "n", "hub")
        # The hub and some drawn members are pivots; of a small bucket all members are, which is all pairs.
        lot = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 30)) / float(1 << 30)
        drawn = F.lit(pivots > 1) & ((F.col("n") <= 2 * pivots) | (lot < F.lit(float(pivots)) / F.col("n")))
        rest = stored(rooted.join(mixed, "bucket").select("bucket", "node", "met", "size", "place", "root", ((F.col("node") == F.col("hub")) | drawn).alias("pivot")))
        if not rest.take(1):
            return labels
        chosen = rest.where("pivot").select("bucket", F.col("node").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("place").alias("px"))
        # If this is the first shingle that two prefixes share, no more than what follows it can be shared besides.
        enough = F.lit(banded) | (1 + F.least(F.col("size") - F.col("place"), F.col("sx") - F.col("px")) >= p.threshold / (1 + p.threshold) * (F.col("size") + F.col("sx")) - 1e-6)
        new = rest.join(chosen, "bucket").where("root <> rx and (node < x or not pivot)").where(enough).select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()
        new = stored(new.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(new)  # each round's part stays as it was written
        links = _linked(new, texts, p).join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        links = stored(links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
        if links.take(1):
            labels = relabelled(labels, components(links))
        open_members = stored(rest.where("not pivot").select("bucket", "node", "met", "size", "place"))
        if banded:
            # What the hubs leave goes on by rare shingles: texts that share a common passage alone don't meet there.
            banded = False
            left = open_members.select("node").distinct()
            open_members = _weighted(stored(_prefixes(texts.join(left, "node", "left_semi"), p)))
        else:
            pivots *= 8


def _rows(docs: DataFrame, p: Params, id_col: str, text_col: str) -> DataFrame:
    """(id, node, root) of every row."""
    labels = classes(docs, p, text_col)
    light = docs.select(F.col(id_col).alias("id"), node(F.col(text_col)).alias("node"))
    return stored(light.join(labels, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root")))


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size of every document."""
    rooted = _rows(docs, p, "doc_id", "text")
    size = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rooted.join(size, "root").select(F.col("id").alias("doc_id"), "class_id", "class_size")


def deduplicated(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one of the least key, with all columns as they are."""
    rooted = _rows(docs, p, id_col, text_col)
    least = rooted.groupBy("root").agg(F.min("id").alias("class_id"))
    chosen = rooted.join(least, "root").where(F.col("id").eqNullSafe(F.col("class_id")))
    # Rows of equal keys in a class: the least text, and one of the copies of that.
    winner = chosen.groupBy("root").agg(F.min("node").alias("_node"), F.min("id").alias("_id"), F.count("*").alias("_rows")).drop("root")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.col(id_col).alias("_key"), node(F.col(text_col)).alias("_own"))
    kept = rows.join(stored(winner), (F.col("_own") == F.col("_node")) & F.col("_key").eqNullSafe(F.col("_id")))
    once = kept.where("_rows = 1").select("document")
    again = kept.where("_rows > 1").groupBy("_node").agg(F.first("document").alias("document")).select("document")
    return once.union(again).select("document.*")
