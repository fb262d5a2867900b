"""Language-model scores of a hidden Markov model over words.

A word belongs to one of a fixed number of classes by its form: a short word by a
hash of all of it, a longer one by a hash of its last bytes, the end of a text to
one of its own.  A latent state emits a class, and a class emits its words in
proportion to their smoothed counts in the training texts:

    P(word | state) = P(class | state) * (c + 0.5) / (N_class + 0.5 * (V_class + 1))

Start, transition and class probabilities are trained by Baum-Welch on all
training texts: tasks run the scaled forward and backward recursions and emit
expected counts, which are summed across partitions.  The likelihood of a whole
text comes exactly from the scaled forward recursion.

Texts are read once, into a row for each document with its classes and one for
each block of documents with its distinct words and where they are.  Words are
counted by a grouped sum that combines in the tasks first.  Words of a share of
``frequent`` of all tokens or more, of which there are 1 / frequent at most, are
broadcast with their counts; all others are asked for by one row for each block
that holds them, so that no key has more than that share of the rows, and what is
found goes back to its block.  What the driver sees are these counts, class totals
and model parameters, all of bounded size.

Defined results: a null or empty text is its end token alone; a very long text is a
block of its own, its recursion carried from window to window; null keys and
repeated rows are kept (repeats count as often as they are there); without
training texts all tokens are unknown; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.tables import remainder, stored


@dataclass(frozen=True)
class Params:
    states: int = 8
    short_classes: int = 1024
    suffix_classes: int = 1024
    short_bytes: int = 4
    suffix_bytes: int = 3
    iterations: int = 4
    seed: int = 5
    #: Tokens of a window: sequences are cut into windows for training, and for the parallel recursion of scoring.
    window: int = 128
    #: Share of all tokens from which a word's count is broadcast.
    frequent: float = 1e-6

    @property
    def classes(self) -> int:
        return self.short_classes + self.suffix_classes + 1


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)


_END = np.uint64(0x454E44)
_SLICE = 2 * tokens.SLICE_BYTES


def tokenised(texts: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class) of all tokens with the end of each text, and the offsets by document."""
    data, at = tokens.buffers(texts)
    data = tokens.ascii_lower(data)
    prefix = tokens.Prefix(data)
    w = tokens.words(data, at, prefix=prefix)
    size = w.end - w.start
    tail = prefix.spans(np.maximum(w.start, w.end - p.suffix_bytes), w.end)
    kind = np.where(size <= p.short_bytes, w.hash % np.uint64(p.short_classes), np.uint64(p.short_classes) + tail % np.uint64(p.suffix_classes))
    n = len(at) - 1
    first = w.first + np.arange(n + 1)
    hashes, kinds = np.full(first[-1], _END, np.uint64), np.full(first[-1], p.classes - 1, np.uint16)
    place = np.arange(len(w.hash)) + w.doc
    hashes[place], kinds[place] = w.hash, kind
    return hashes, kinds, first


_READ = "whole boolean, block long, row int, doc_id {}, held_out boolean, n long, kinds binary, words binary, word_kinds binary, seen binary, each binary, docs binary, times binary"
_NAMES = [x.split()[0] for x in _READ.split(", ")]


def _reader(p: Params, id_type: pa.DataType):
    """Turns (doc_id, held_out, text) batches into a row for each document, and one (whole) for each block of them."""

    types = [pa.bool_(), pa.int64(), pa.int32(), id_type, pa.bool_(), pa.int64(), *[pa.binary()] * 7]

    def batch_of(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[k].cast(t) if k in given else pa.nulls(n, t) for k, t in zip(_NAMES, types, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in tokens.slices(batch, 2, _SLICE):
                block += 1
                n = len(part)
                read = [tokenised(x.column(2), p) for x in tokens.slices(part, 2, _SLICE // 4)]
                hashes, kinds = (np.concatenate([x[k] for x in read]) for k in (0, 1))
                size = np.concatenate([np.diff(x[2]) for x in read])
                first = np.concatenate([[0], np.cumsum(size)])
                sequences = [kinds[first[i] : first[i + 1]].tobytes() for i in range(n)]
                yield batch_of(n, {"whole": pa.array(np.zeros(n, bool)), "block": pa.array(np.full(n, block)), "row": pa.array(np.arange(n)), "doc_id": part.column(0), "held_out": part.column(1), "n": pa.array(size), "kinds": pa.array(sequences, pa.binary())})

                word, back = np.unique(hashes, return_inverse=True)
                kind = np.zeros(len(word), np.uint16)
                kind[back] = kinds
                pair, times = np.unique(back.astype(np.int64) * n + np.repeat(np.arange(n), size), return_counts=True)
                of, doc = pair // n, pair % n
                trained = ~np.asarray(part.column(1).to_pylist(), bool)
                seen = np.bincount(of, times * trained[doc], minlength=len(word)).astype(np.uint32)
                packed = lambda x, t: pa.array([x.astype(t).tobytes()], pa.binary())
                given = {"words": packed(word, np.uint64), "word_kinds": packed(kind, np.uint16), "seen": packed(seen, np.uint32), "each": packed(np.bincount(of, minlength=len(word)), np.uint32), "docs": packed(doc, np.uint32), "times": packed(times, np.uint32)}
                yield batch_of(1, {"whole": pa.array([True]), "block": pa.array([block]), **given})

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, n) of blocks' (words, word_kinds, seen), added up over a task's blocks as far as they are at hand."""
    held: list[tuple[np.ndarray, ...]] = []

    def added() -> pa.RecordBatch:
        words, kinds, seen = (np.concatenate([h[k] for h in held]) for k in range(3))
        word, at, back = np.unique(words, return_index=True, return_inverse=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(kinds[at].astype(np.int32)), pa.array(np.bincount(back, seen).astype(np.int64))], ["word", "kind", "n"])

    for batch in batches:
        for part in tokens.slices(batch, 0):
            for words, kinds, seen in zip(*(c.to_pylist() for c in part.columns), strict=True):
                times = np.frombuffer(seen, np.uint32)
                some = times > 0
                held.append((np.frombuffer(words, np.uint64)[some], np.frombuffer(kinds, np.uint16)[some], times[some]))
            if sum(len(h[0]) for h in held) > 1_000_000:
                yield added()
    if held:
        yield added()


def _among(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words would stand among known ones (sorted), and whether they do."""
    at = np.minimum(np.searchsorted(known, words), max(0, len(known) - 1))
    return at, known[at] == words if len(known) else np.zeros(len(words), bool)


def _asked(shared: Broadcast):
    """(block, at, word) of the words of blocks (block, words) that are not frequent; ``at`` is their place among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value[0]
        for batch in batches:
            for part in tokens.slices(batch, 1):
                for block, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = np.frombuffer(raw, np.int64)
                    rare = words[~_among(words, frequent)[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rare), block)), pa.array(np.arange(len(rare), dtype=np.int32)), pa.array(rare)], ["block", "at", "word"])

    return run


def _sums(own: np.ndarray, docs: np.ndarray, times: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents the logarithms of its tokens' counts, and how many of them are above 0."""
    return np.bincount(docs, times * np.log10(count + 0.5)[own], minlength=n), np.bincount(docs, times * (count > 0)[own], minlength=n).astype(np.uint32)


def _begun(shared: Broadcast):
    """(block, each, docs, times, logs, known) of blocks (block, words, each, docs, times): sums over frequent words, and where the others are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = shared.value
        for batch in batches:
            for part in tokens.slices(batch, (1, 3, 4)):
                for r in part.to_pylist():
                    words, each = np.frombuffer(r["words"], np.int64), np.frombuffer(r["each"], np.uint32)
                    docs, times = np.frombuffer(r["docs"], np.uint32), np.frombuffer(r["times"], np.uint32).astype(np.int64)
                    at, there = _among(words, frequent)
                    own, n = np.repeat(np.arange(len(words)), each), int(docs.max()) + 1  # every document has its end token
                    top = there[own]
                    logs, known = _sums(at[own[top]], docs[top], times[top], counts, n)
                    left = [each[~there], docs[~top], times[~top].astype(np.uint32), logs, known]
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), *(pa.array([x.tobytes()], pa.binary()) for x in left)], ["block", "each", "docs", "times", "logs", "known"])

    return run


_SUMMED = pa.schema([("block", pa.int64()), ("row", pa.int32()), ("logs", pa.float64()), ("n_known", pa.int64())])


def _summed(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """(block, row, logs, n_known) of a block's documents, from what was begun and the counts found for its rarer words."""
    out = []
    for r in blocks.to_pylist():
        each, docs, times = (np.frombuffer(r[k], np.uint32) for k in ("each", "docs", "times"))
        logs, known = np.frombuffer(r["logs"], np.float64), np.frombuffer(r["known"], np.uint32).astype(np.int64)
        count = np.zeros(len(each), np.int64)
        count[found["at"].to_numpy()] = found["n"].to_numpy()
        more, seen = _sums(np.repeat(np.arange(len(each)), each), docs, times, count, len(logs))
        out.append(pa.table([pa.array(np.full(len(logs), r["block"])), pa.array(np.arange(len(logs), dtype=np.int32)), pa.array(logs + more), pa.array(known + seen)], schema=_SUMMED))
    return pa.concat_tables(out) if out else _SUMMED.empty_table()


def _windows(sequences: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(windows x tokens) of classes, padded by the class after the last, and each window's sequence."""
    count = np.array([-(-len(s) // p.window) for s in sequences], np.int64)
    out = np.full((count.sum(), p.window), p.classes, np.int64)
    flat, at = out.reshape(-1), 0
    for s, n in zip(sequences, count.tolist(), strict=True):
        flat[at : at + len(s)] = s
        at += n * p.window
    return out, np.repeat(np.arange(len(sequences)), count)


def expected(windows: np.ndarray, m: Model, p: Params, first: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, steps and emissions over windows, and their log10 likelihood.

    ``first`` tells which windows start a sequence, ``before`` and ``after`` have the states ahead
    of the others and the weights of what follows; without them every window is a sequence.
    """
    emit = np.vstack([m.emit, np.ones(p.states)])
    obs = np.ascontiguousarray(windows.T)
    length, n = obs.shape
    alpha, scale = np.empty((length, n, p.states)), np.empty((length, n))
    a = (m.start if first is None else np.where(first[:, None], m.start, before @ m.step)) * emit[obs[0]]
    for t in range(length):
        if t:
            a = (a @ m.step) * emit[obs[t]]
        scale[t] = a.sum(axis=1)
        a = a / scale[t][:, None]
        alpha[t] = a
    real = obs < p.classes
    steps, beta = np.zeros((p.states, p.states)), np.ones((n, p.states))
    gamma = alpha
    if after is not None:
        beta = after / (alpha[-1] * after).sum(axis=1)[:, None]
        gamma[-1] *= beta
    for t in range(length - 2, -1, -1):
        ahead = emit[obs[t + 1]] * beta / scale[t + 1][:, None]
        steps += alpha[t].T @ (ahead * real[t + 1][:, None])
        beta = ahead @ m.step.T
        gamma[t] *= beta
    emitted = np.stack([np.bincount(obs.ravel(), gamma[:, :, s].ravel(), minlength=p.classes + 1)[: p.classes] for s in range(p.states)], axis=1)
    starts = gamma[0]
    if first is not None:
        steps += before[~first].T @ (emit[obs[0]] * beta / scale[0][:, None])[~first]
        starts = starts[first]
    return starts.sum(axis=0), steps * m.step, emitted, float(np.log10(scale[real]).sum())


def expected_whole(sequences: list[np.ndarray], m: Model, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """``expected`` over whole sequences: forward and backward vectors are carried from window to window."""
    windows, of = _windows(sequences, p)
    number, product, _ = _products(windows, of, m, p)
    before, after = np.tile(m.start, (len(of), 1)), np.ones((len(of), p.states))
    order = np.argsort(number, kind="stable")
    rounds = np.split(order, np.cumsum(np.bincount(number))[:-1]) if len(of) else []
    for own in rounds[1:]:
        v = np.einsum("ns,nst->nt", before[own - 1], product[own - 1])
        before[own] = v / v.sum(axis=1)[:, None]
    for own in rounds[:0:-1]:
        v = np.einsum("nst,nt->ns", product[own], after[own])
        after[own - 1] = v / v.sum(axis=1)[:, None]
    out = [np.zeros_like(m.start), np.zeros_like(m.step), np.zeros_like(m.emit), 0.0]
    for i in range(0, len(of), 1024):
        c = slice(i, i + 1024)
        out = [x + y for x, y in zip(out, expected(windows[c], m, p, number[c] == 0, before[c], after[c]), strict=True)]
    return tuple(out)


def _products(windows: np.ndarray, of: np.ndarray, m: Model, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's number in its sequence, and its scaled forward recursion as a matrix, with the log10 of the scale."""
    emit = np.vstack([m.emit, np.ones(p.states)])
    number = np.arange(len(of)) - np.searchsorted(of, of)
    product, scale = np.empty((len(of), p.states, p.states)), np.zeros(len(of))
    step = 1024
    for i in range(0, len(of), step):
        obs = windows[i : i + step].T
        begin = np.where((number[i : i + step] == 0)[:, None, None], np.eye(p.states), m.step)
        x = begin * emit[obs[0]][:, None, :]
        for t in range(1, p.window):
            x = (x.reshape(-1, p.states) @ m.step).reshape(x.shape) * emit[obs[t]][:, None, :]
            if t % 8 == 7 or t == p.window - 1:
                top = x.max(axis=(1, 2))
                x /= top[:, None, None]
                scale[i : i + step] += np.log10(top)
        product[i : i + step] = x
    return number, product, scale


def log_likelihoods(sequences: list[np.ndarray], m: Model, p: Params) -> np.ndarray:
    """Exact log10 likelihoods of whole class sequences.

    The scaled forward recursion of a window is a product of matrices, made for all
    windows at once; then each sequence's windows are applied in order.
    """
    windows, of = _windows(sequences, p)
    number, product, scale = _products(windows, of, m, p)
    state, out = np.tile(m.start, (len(sequences), 1)), np.zeros(len(sequences))
    for k in range(number.max() + 1 if len(number) else 0):
        own = np.flatnonzero(number == k)
        doc = of[own]
        v = np.einsum("ns,nst->nt", state[doc], product[own])
        total = v.sum(axis=1)
        state[doc] = v / total[:, None]
        out[doc] += np.log10(total) + scale[own]
    return out


def _expectations(rows: DataFrame, m: Model, p: Params) -> Model:
    """One round of Baum-Welch over all rows of (kinds)."""
    shapes = [("start", m.start.size), ("step", m.step.size), ("emit", m.emit.size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(n for _, n in shapes))
        for batch in batches:
            for part in tokens.slices(batch, 0):
                start, step, emit, _ = expected_whole([np.frombuffer(x, np.uint16) for x in part.column(0).to_pylist()], m, p)
                total += np.concatenate([start, step.ravel(), emit.ravel()])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "v"])

    found = rows.select("kinds").mapInArrow(tokens.tidied(run), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # parameters of the model
    total = np.zeros(sum(n for _, n in shapes))
    for r in found:
        total[r["k"]] = r["v"]
    start, step, emit = np.split(total, np.cumsum([n for _, n in shapes])[:2])
    share = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = emit.reshape(m.emit.shape) + 0.01
    return Model(share(start + 0.1), share(step.reshape(m.step.shape) + 0.1), emit / emit.sum(axis=0))


def first_model(totals: np.ndarray, p: Params) -> Model:
    """Seeded noise around the shares of the classes, with states that tend to stay."""
    rng = np.random.default_rng(p.seed)
    emit = (totals + 0.5)[:, None] * rng.gamma(1.0, size=(p.classes, p.states))
    step = np.full((p.states, p.states), 0.2 / max(1, p.states - 1))
    np.fill_diagonal(step, 0.8 if p.states > 1 else 1.0)
    return Model(np.full(p.states, 1 / p.states), step, emit / emit.sum(axis=0))


def score(docs: DataFrame, p: Params = Params(), held_out: tuple[int, int] = (5, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    from pyspark.sql.pandas.types import to_arrow_type

    given = docs.select(F.col(id_col), (remainder(F.col(id_col), held_out[0]) == held_out[1]).alias("held_out"), F.col(text_col))
    id_type = docs.schema[id_col].dataType
    read = stored(given.mapInArrow(tokens.tidied(_reader(p, to_arrow_type(id_type))), _READ.format(id_type.simpleString())))
    texts = read.where("not whole").select("block", "row", "doc_id", "held_out", "n", "kinds")
    blocks = read.where("whole")

    counts = blocks.select("words", "word_kinds", "seen").mapInArrow(tokens.tidied(_counted), "word long, kind int, n long").groupBy("word").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"))
    counts = stored(counts)
    totals, types = np.zeros(p.classes, np.int64), np.zeros(p.classes, np.int64)
    for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # one row for each class
        totals[r["kind"]], types[r["kind"]] = r["n"], r["types"]
    all_tokens, all_types = int(totals.sum()), int(types.sum())
    often = F.col("n") >= max(1, math.ceil(p.frequent * all_tokens))
    top = counts.where(often).select("word", "n").toArrow().sort_by("word")  # 1 / frequent rows at most
    shared = docs.sparkSession.sparkContext.broadcast((top["word"].to_numpy(), top["n"].to_numpy()))
    asked = blocks.select("block", "words").mapInArrow(tokens.tidied(_asked(shared)), "block long, at int, word long")
    found = asked.join(counts.where(~often).select("word", "n"), "word").select("block", "at", "n")
    begun = blocks.select("block", "words", "each", "docs", "times").mapInArrow(tokens.tidied(_begun(shared)), "block long, each binary, docs binary, times binary, logs binary, known binary")
    sums = begun.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_summed, "block long, row int, logs double, n_known long")

    model = first_model(totals, p)
    training = texts.where("not held_out")
    for _ in range(p.iterations):
        model = _expectations(training, model, p)
    base_norm = np.log10(all_tokens + 0.5 * (all_types + 1))
    class_norm = np.log10(totals + 0.5 * (types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 5):
                own = [np.frombuffer(x, np.uint16).astype(np.int64) for x in part.column(5).to_pylist()]
                first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
                norm = tokens.sums(class_norm[np.concatenate(own)], first)
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(log_likelihoods(own, model, p) - norm)], ["block", "row", "doc_id", "held_out", "n_tokens", "latent"])

    scored = texts.mapInArrow(tokens.tidied(run), f"block long, row int, doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, latent double")
    return scored.join(sums, ["block", "row"]).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(all_tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * float(base_norm)).alias("base_score"), (F.col("logs") + F.col("latent")).alias("score"))

