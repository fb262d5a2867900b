"""Language identification by language bitmasks of n-grams.

A language's profile is the byte n-grams of its training texts whose share is at
least ``least_share``: at most 1 / least_share of each length.  All profiles
stand in one bit-sliced Bloom filter: a slot holds one bit for each language, an
n-gram sets its language's bit in ``hashes`` slots, and the bitwise AND of an
n-gram's slots is the set of all languages that contain it.  A text's hits are
counted per language, corrected for the share of n-grams that pass a language's
filter by chance, and the language with most decides.

Defined results: ``und`` with score 0 where the text is null or has no letter, or
nothing could be learned; ties go to the language first in code point order;
null keys and repeated rows are kept; a very long text is read whole; an empty
table gives an empty result; more than ``max_languages`` languages are an error;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import tokens
from quire.llm.tables import remainder, stored

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (3, 4)
    least_share: float = 3e-5
    hashes: int = 3
    #: Slots of the filter per n-gram of the largest profile.
    slots_each: float = 8.0
    #: Bound of the sample that profiles are fitted on: about so many rows of each language.
    max_rows: int = 4_000
    #: The driver holds a profile for each language: more than so many are refused.
    max_languages: int = 4_096


@dataclass(frozen=True)
class Filter:
    languages: list[str]
    slots: np.ndarray  # uint64, (words, slots): bit l % 64 of word l // 64 is language l
    hashes: int
    sizes: tuple[int, ...]
    false_rate: np.ndarray  # by language

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as words of bits."""
        bits = np.uint64(64 - (self.slots.shape[1] - 1).bit_length())
        out = None
        for i in range(self.hashes):
            at = (tokens.mix(grams + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> bits).astype(np.int64)
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out


def grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n bytes within lower-cased texts, and the offsets by document."""
    data, at = tokens.buffers(pc.utf8_lower(pc.fill_null(texts, "")))
    gap = tokens.NOT_ALNUM[data]
    data = np.where(gap, np.uint8(32), data)
    found = tokens.Prefix(data).grams(n)
    size = np.maximum(np.diff(at) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    start = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], size)
    return found[start], first


def _counted(sample: DataFrame, p: Params) -> DataFrame:
    """(lang, n, gram, count) summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 0, 8 * tokens.SLICE_BYTES):
                langs = part.column(1)
                for lang in pc.unique(langs).to_pylist():
                    texts = part.column(0).filter(pc.equal(langs, lang))
                    for n in p.sizes:
                        found, count = np.unique(grams(texts, n)[0], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), n, np.int32)), pa.array(found.view(np.int64)), pa.array(count)], ["lang", "n", "gram", "count"])

    return sample.mapInArrow(tokens.tidied(run), "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def train(docs: DataFrame, p: Params = Params(), held_out: tuple[int, int] | None = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if held_out:
        rows = rows.where(remainder(F.col(id_col), held_out[0]) != held_out[1])
    per = rows.groupBy(F.col(lang_col).alias("lang")).count()
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    # Written first, so that its size is known: one row a language is broadcast, and texts are not shuffled.
    share = stored(per.select(F.col("lang").alias("_l"), (F.lit(float(p.max_rows)) / F.col("count")).alias("_share")))
    if share.count() > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages to learn")
    sample = rows.join(share, F.col(lang_col) == F.col("_l")).where(u < F.col("_share")).select(F.col(text_col).alias("text"), F.col("_l").alias("lang"))
    counts = _counted(sample, p)
    counts = counts.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("lang", "n")))  # profiles of a bounded sample
    kept = counts.where(F.col("share") >= p.least_share).select("lang", "gram").collect()  # languages x lengths / least_share rows at most
    return build([(r["lang"], r["gram"]) for r in kept], p)


def build(profile: list[tuple[str, int]], p: Params) -> Filter:
    languages = sorted({lang for lang, _ in profile})
    by = {lang: np.array([g for x, g in profile if x == lang], np.int64).view(np.uint64) for lang in languages}
    most = max([1, *map(len, by.values())])
    size = 1 << max(10, int(most * p.slots_each - 1).bit_length())
    out = Filter(languages, np.zeros((max(1, -(-len(languages) // 64)), size), np.uint64), p.hashes, p.sizes, np.zeros(len(languages)))
    bits = np.uint64(64 - (size - 1).bit_length())
    for k, lang in enumerate(languages):
        for i in range(p.hashes):
            at = (tokens.mix(by[lang] + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> bits).astype(np.int64)
            out.slots[k // 64, at] |= np.uint64(1 << k % 64)
        out.false_rate[k] = ((out.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() ** p.hashes
    return out


def corrected(texts: pa.Array, f: Filter) -> np.ndarray:
    """(documents x languages) shares of n-grams that a language contains, beyond false positives."""
    hits, total = np.zeros((len(texts), len(f.languages))), np.zeros(len(texts))
    for n in f.sizes:
        found, first = grams(texts, n)
        masks = f.masks(found)
        total += np.diff(first)
        for k in range(len(f.languages)):
            hits[:, k] += tokens.sums((masks[k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int8), first)
    share = np.divide(hits, total[:, None], out=np.zeros_like(hits), where=total[:, None] > 0)
    return np.clip((share - f.false_rate) / (1 - f.false_rate), 0, 1)


def predict(docs: DataFrame, f: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*f.languages, UNKNOWN], object)
        for batch in batches:
            for part in tokens.slices(batch, 1):
                texts = pc.fill_null(part.column(1), "")
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                if f.languages:
                    share = corrected(texts, f)
                    best = share.argmax(axis=1)
                    top = share[np.arange(len(best)), best]
                    score = np.divide(top, share.sum(axis=1), out=np.zeros(len(best)), where=top > 0)
                else:
                    best, score = np.full(len(part), -1), np.zeros(len(part))
                best, score = np.where(letters, best, -1), np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tokens.tidied(run), f"`{id_col}` {kind}, lang_pred string, score double")


def language(docs: DataFrame, p: Params = Params(), held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    f = train(docs, p, held_out)
    return predict(docs, f).select("doc_id", (remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"), "lang_pred", "score")
