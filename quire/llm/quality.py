"""Quality rules: fixed rules of a text's words, then a calibrated classifier.

The classifier is a logistic regression on hashed n-grams of words (1 and 2
words) and of characters (runs of 2 to 4 bytes of UTF-8), each family as shares of
the text's n-grams, trained by AdaGrad on labelled quality rows.  A part of the
sample that training does not see calibrates its scores to probabilities (Platt
scaling).  Arrow batches are scored against a fixed threshold.

Defined results: a null or empty text has no words, counts of 0, and fails the
base rules; a very long text is counted and scored whole; without labels of both kinds every text that passes the base rules
is kept; null keys and repeated rows are kept; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm import tokens
from quire.llm.tables import in_one_task, labelled_sample, until

#: Base rules: fewest words, and the most repeated words in percent.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Params:
    bits: int = 18
    word_sizes: tuple[int, ...] = (1, 2)
    char_sizes: tuple[int, ...] = (2, 3, 4)
    #: Shares of n-grams are multiplied by this, so that weights stay near 1.
    scale: float = 30.0
    rate: float = 0.5
    l2: float = 1e-6
    epochs: int = 6
    #: Bounds of the sample of labelled rows, of which every fifth calibrates: rows, and bytes of their texts.
    max_rows: int = 8_000
    max_bytes: int = 64_000_000
    #: Texts of a lower probability of good quality are not kept.
    threshold: float = 0.5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, (families, 2**bits)
    bias: float
    slope: float  # of the calibration
    shift: float


_SYMBOLS = tokens._table(b"#*$%&|<>")
_NEWLINE = tokens._table(b"\n")


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, at = tokens.buffers(texts)
    prefix = tokens.Prefix(data)
    w = tokens.words(data, at, prefix=prefix)
    n = len(at) - 1
    word_byte = ~tokens.SPACES[data]
    out = {"n_words": np.diff(w.first)}
    out["word_chars"] = tokens.sums((word_byte & ((data & 0xC0) != 0x80)).astype(np.int8), at)
    out["n_symbols"] = tokens.sums(_SYMBOLS[data].astype(np.int8), at)

    lines = tokens.words(data, at, _NEWLINE, prefix)
    filled = np.concatenate([[0], np.cumsum(word_byte)])
    real = filled[lines.end] > filled[lines.start]
    keys = np.unique(np.stack([lines.doc[real].astype(np.uint64), lines.hash[real]]), axis=1)[0] if real.any() else np.zeros(0, np.uint64)
    out["n_dup_lines"] = np.bincount(lines.doc[real], minlength=n) - np.bincount(keys.astype(np.int64), minlength=n)

    covered = np.zeros(len(w.hash), bool)
    if len(w.hash) > 2:
        inside = np.flatnonzero(w.doc[2:] == w.doc[:-2])
        h = w.hash[inside] * np.uint64(0x9E3779B97F4A7C15) + w.hash[inside + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + w.hash[inside + 2] * np.uint64(0x165667B19E3779F9)
        h = tokens.mix(h + tokens.mix(w.doc[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        for j in range(3):
            covered[inside[twice] + j] = True
    out["n_repeat_words"] = tokens.sums(covered.astype(np.int8), w.first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def families(texts: pa.Array, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: the features of all texts, and the offsets by document."""
    data, at = tokens.buffers(texts)
    prefix = tokens.Prefix(data)
    w = tokens.words(data, at, prefix=prefix)
    shift = np.uint64(64 - p.bits)
    for n in p.word_sizes:
        size = np.maximum(np.diff(w.first) - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(size)])
        start = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], size)
        h = w.hash[start]
        for j in range(1, n):
            h = tokens.mix(h * np.uint64(3) + w.hash[start + j])
        yield (h >> shift).astype(np.int64), first
    for n in p.char_sizes:
        size = np.maximum(np.diff(at) - n + 1, 0)
        first = np.concatenate([[0], np.cumsum(size)])
        start = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], size)
        yield (prefix.grams(n)[start] >> shift).astype(np.int64), first


def fit(examples: list[tuple[np.ndarray, np.ndarray, float]], p: Params) -> Model:
    """AdaGrad over examples (features, values, label); every fifth calibrates."""
    size = (len(p.word_sizes) + len(p.char_sizes)) << p.bits
    w, g2 = np.zeros(size), np.full(size, 1e-8)
    bias, bias_g2 = 0.0, 1e-8
    learn = [e for i, e in enumerate(examples) if i % 5]
    for _ in range(p.epochs):
        for idx, value, label in learn:
            g = 1 / (1 + np.exp(-np.clip(w[idx] @ value + bias, -35, 35))) - label
            each = g * value + p.l2 * w[idx]
            g2[idx] += each * each
            w[idx] -= p.rate * each / np.sqrt(g2[idx])
            bias_g2 += g * g
            bias -= p.rate * g / bias_g2**0.5
    slope, shift = _platt([(w[idx] @ value + bias, label) for i, (idx, value, label) in enumerate(examples) if not i % 5])
    return Model(w.reshape(-1, 1 << p.bits).astype(np.float32), bias, slope, shift)


def _platt(pairs: list[tuple[float, float]]) -> tuple[float, float]:
    """Slope and shift of the logistic curve from scores to labels, by Newton steps with a slight pull to (1, 0)."""
    s, y = np.array([x for x, _ in pairs]), np.array([t for _, t in pairs])
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * s + b, -35, 35)))
        d = q * (1 - q)
        grad = np.array([((q - y) * s).sum() + (a - 1), (q - y).sum() + b])
        hess = np.array([[(d * s * s).sum() + 1, (d * s).sum()], [(d * s).sum(), d.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def train(sample: DataFrame, p: Params = Params()) -> Model | None:
    """Fits in one task over a sample of at most p.max_rows rows (turn, text, label), and p.max_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for part in until(batches, p.max_bytes):
            found = list(families(part.column(1), p))
            for i, label in enumerate(part.column(2).to_pylist()):
                idx, value = [], []
                for k, (h, first) in enumerate(found):
                    own, count = np.unique(h[first[i] : first[i + 1]], return_counts=True)
                    idx.append(own + (k << p.bits))
                    value.append(count * (p.scale / max(1, count.sum())))
                examples.append((np.concatenate(idx).astype(np.int32), np.concatenate(value).astype(np.float32), label))
        if len({label for *_, label in examples}) > 1:
            m = fit(examples, p)
            yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([m.slope]), pa.array([m.shift])], ["weights", "bias", "slope", "shift"])

    row = in_one_task(sample).mapInArrow(tokens.tidied(run), "weights binary, bias double, slope double, shift double").first()
    return row and Model(np.frombuffer(row["weights"], np.float32).reshape(-1, 1 << p.bits), row["bias"], row["slope"], row["shift"])


def probabilities(texts: pa.Array, m: Model, p: Params) -> np.ndarray:
    total = np.full(len(texts), m.bias)
    for k, (h, first) in enumerate(families(texts, p)):
        size = np.diff(first)
        total += np.divide(tokens.sums(m.weights[k][h].astype(np.float64), first) * p.scale, size, out=np.zeros(len(texts)), where=size > 0)
    return 1 / (1 + np.exp(-np.clip(m.slope * total + m.shift, -35, 35)))


def rules(docs: DataFrame, m: Model | None, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, probability) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(m)  # families * 2**bits numbers
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tokens.slices(batch, 1):
                texts = pc.fill_null(part.column(1), "")
                counts = base_counts(texts)
                failed = base_failed(counts)
                good = probabilities(texts, model, p) if model else np.ones(len(part))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[n]) for n in names), pa.array(failed), pa.array(~failed & (good >= p.threshold)), pa.array(good)], [id_col, *names, "base_failed", "kept", "probability"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tokens.tidied(run), f"`{id_col}` {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, probability double")


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), held_out: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, probability of every document."""
    return rules(docs, train(labelled_sample(docs, labels, "quality", p.max_rows, held_out), p), p)
