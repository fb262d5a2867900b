"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed word unigrams, bigrams and skip-grams (one word left out),
each counted once per document.  FTRL-proximal keeps a learning rate for each
coordinate, and its L1 term leaves most weights at exactly zero, so what goes to
the executors is a few thousand pairs (at most 2**bits).

Defined results: a null or empty text has no feature and scores the bias; a very
long text is scored whole; null keys are kept; repeated rows get equal scores; an
empty table gives an empty result; other columns are not read, and carried as they
are by ``without_toxic``, which keeps every row where no weight was learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.tables import in_one_task, labelled_sample, remainder, until


@dataclass(frozen=True)
class Params:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.0
    epochs: int = 4
    #: Bounds of the sample of labelled rows that the model is fitted on: rows, and bytes of their texts.
    max_rows: int = 12_000
    max_bytes: int = 128_000_000


@dataclass(frozen=True)
class Model:
    index: np.ndarray  # uint32, ascending
    weight: np.ndarray  # float32
    bias: float
    bits: int


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every occurrence of a unigram, bigram or skip-gram."""
    data, at = tokens.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    w = tokens.words(data, at, tokens.NOT_ALNUM)
    shift = np.uint64(64 - bits)
    found, docs = [w.hash >> shift], [w.doc]
    for gap, seed in ((1, 0x51ED270B7A3F1D25), (2, 0x2545F4914F6CDD1D)):
        if len(w.hash) > gap:
            same = w.doc[gap:] == w.doc[:-gap]
            pair = tokens.mix(w.hash[:-gap] * np.uint64(3) + w.hash[gap:] * np.uint64(seed))
            found.append((pair >> shift)[same])
            docs.append(w.doc[gap:][same])
    return np.concatenate(found).astype(np.uint32), np.concatenate(docs)


def fit(examples: list[tuple[np.ndarray, float]], p: Params) -> Model:
    """FTRL-proximal over examples (distinct features, label) in the given order."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias_z = bias_n = 0.0

    def weight(zi, ni):
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for idx, label in examples:
            zi, ni = z[idx], n[idx]
            w = weight(zi, ni)
            b = -bias_z / ((p.beta + bias_n**0.5) / p.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha
            z[idx] = zi + g - sigma * w
            n[idx] = ni + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / p.alpha * b
            bias_n += g * g
    w = weight(z, n)
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.uint32), w[kept].astype(np.float32), float(-bias_z / ((p.beta + bias_n**0.5) / p.alpha)), p.bits)


def train(sample: DataFrame, p: Params = Params()) -> Model:
    """Fits the model in one task over a sample of at most ``p.max_rows`` rows (turn, text, label), and ``p.max_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for part in until(batches, p.max_bytes):
            idx, doc = features(part.column(1), p.bits)
            cut = np.searchsorted(doc[(order := np.argsort(doc, kind="stable"))], np.arange(len(part) + 1))
            for i, label in enumerate(part.column(2).to_pylist()):
                examples.append((np.unique(idx[order[cut[i] : cut[i + 1]]]), label))
        model = fit(examples, p)
        yield pa.RecordBatch.from_arrays([pa.array([model.index.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.bias])], ["index", "weight", "bias"])

    # The sample is bounded, and so is this one row.
    row = in_one_task(sample).mapInArrow(tokens.tidied(run), "index binary, weight binary, bias double").first()
    if row is None:
        return Model(np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0, p.bits)
    return Model(np.frombuffer(row["index"], np.uint32), np.frombuffer(row["weight"], np.float32), row["bias"], p.bits)


def scores(texts: pa.Array, model: Model, table: np.ndarray) -> np.ndarray:
    """Probabilities of the texts of one slice. table: the weights, dense."""
    idx, doc = features(texts, model.bits)
    hit = np.flatnonzero(table[idx])
    pairs = np.unique(doc[hit].astype(np.int64) << model.bits | idx[hit])
    total = np.bincount(pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))


def _dense(model: Model) -> np.ndarray:
    table = np.zeros(1 << model.bits, np.float32)
    table[model.index] = model.weight
    return table


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _dense(model)
        for batch in batches:
            for part in tokens.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(part.column(1), model, table))], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tokens.tidied(run), f"`{id_col}` {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose score is under the threshold."""
    if not len(model.index):
        return docs
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _dense(model)
        for batch in batches:
            for part in tokens.slices(batch, place):
                yield part.filter(pa.array(scores(part.column(place), model, table) < threshold))

    return docs.mapInArrow(tokens.tidied(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.3, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(labelled_sample(docs, labels, "toxic", p.max_rows, held_out), p)
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
