"""A training-corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept,
and returns a table: all but the last with the columns of documents.  ``run``
writes each stage's rows to the shared folder and reads them for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, linededup, minhash, mixing, toxicity
from quire.llm.tables import labelled_sample, stored, table

TOXIC_FROM = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic.

    Null and empty texts score by the bias alone; rows of equal texts go or stay
    together, whatever their keys; very long texts are scored whole; without labels
    all scores are 0.5 and, as nothing was learned, every row stays.  Other columns,
    whatever their names, are carried as they are.
    """
    p = toxicity.Params()
    model = toxicity.train(labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", p.max_rows, None), p)
    return toxicity.without_toxic(docs, model, TOXIC_FROM)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their source's boilerplate lines gone from the text, and n_chars with them.

    A null text stays null, an empty one empty; null sources are one source; repeated
    rows are cleaned alike; a text may become empty, its row stays.
    """
    return linededup.clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of exact and near copies, that of the least doc_id.

    Null and empty texts are one class; of rows with equal keys in a class one stays;
    a null doc_id counts after all others.
    """
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, three times at most.

    Documents without words (null and empty texts among them) are taken 0 times;
    null sources are one source; rows of equal key and text are taken alike.
    """
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids; the text is what the ids decode to.

    A null text stays null and has no tokens, as an empty one has.  Input columns
    named ids or n_tokens are replaced by this stage's; one named decoded is kept.
    """
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)))
    at = docs.columns.index("text")
    both = bpe.recoded(rows, ranks, public_tokenizers.PATTERN, f"_{at}")
    text = F.when(F.col(f"_{at}").isNotNull(), F.decode("decoded", "utf-8"))
    kept = [(text if i == at else F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in ("n_tokens", "ids")]
    return both.select(*kept, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenise),
]

#: Trained weights and signatures are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
