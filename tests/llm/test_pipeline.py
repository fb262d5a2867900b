import collections
import struct

import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from test_operators import DOC, WORD, brute_classes, labels, odd, plain_mix

from quire.llm import bpe, mixing, toxicity
from quire.llm.tables import labelled_sample, stored, table

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_their_contracts(spark, sf):
    docs = table(spark, sf, "documents")
    columns, rows = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        rows[name] = docs.count()
    assert 0 < rows["line dedup"] == rows["toxicity"] < table(spark, sf, "documents").count()
    assert rows["MinHash near-dedup"] <= rows["line dedup"]
    assert rows["byte-level BPE"] == rows["mixing sources"]
    assert docs.where("n_tokens * 4 <> octet_length(ids)").count() == 0


def test_run_equals_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, sf))
    key = lambda df: sorted((r["doc_id"], r["n_tokens"]) for r in df.collect())
    assert key(pipeline.run(spark, sf)) == key(docs)


def test_empty_documents(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def plain_clean(docs):
    """Texts by key without the lines that stand on over 5 % of a source's distinct texts, and on three at least."""
    pages, lines = collections.defaultdict(set), collections.Counter()
    for text, source in docs.values():
        pages[source].add(text)
    for source, texts in pages.items():
        lines.update((source, x) for t in texts for x in {x.strip(" ") for x in t.split("\n")} if x)
    bad = {(s, x) for (s, x), n in lines.items() if n >= 3 and n > 0.05 * len(pages[s])}
    return {k: ("\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad), s) for k, (t, s) in docs.items()}


def plain_ids(text, ranks, seen):
    out = []
    for piece in regex.findall(public_tokenizers.PATTERN, text):
        if piece not in seen:
            parts = [bytes([b]) for b in piece.encode()]
            while len(parts) > 1:
                n, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if n == 1 << 40:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            seen[piece] = [ranks[x] for x in parts]
        out += seen[piece]
    return out


def test_run_equals_plain_python(spark, sf):
    given = table(spark, sf, "documents")
    p = toxicity.Params()
    model = toxicity.train(labelled_sample(given, table(spark, sf, "labels"), "toxic", p.max_rows, None), p)
    score = {r["doc_id"]: r["score"] for r in toxicity.score(given, model).collect()}
    assert min(score.values()) < pipeline.TOXIC_FROM <= max(score.values())
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in given.collect() if score[r["doc_id"]] < pipeline.TOXIC_FROM}
    docs = plain_clean(docs)
    classes = brute_classes([(k, t) for k, (t, _) in docs.items()])
    docs = {k: v for k, v in docs.items() if classes[k] == k}
    frame = spark.createDataFrame([(k, t) for k, (t, _) in docs.items()], "doc_id long, text string")
    chance = {r["doc_id"]: r["u"] for r in frame.select("doc_id", mixing._random(F.col("doc_id"), F.col("text"), 1).alias("u")).collect()}
    taken = plain_mix(docs, chance)
    ranks, seen = {x: i for i, x in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}, {}
    want = sorted((k, docs[k][0], plain_ids(docs[k][0], ranks, seen)) for k, n in taken.items() for _ in range(n))
    got = sorted((r["doc_id"], r["text"], list(struct.unpack(f"<{r['n_tokens']}I", r["ids"]))) for r in pipeline.run(spark, sf).collect() if WORD.search(r["text"]))
    assert [(k, t) for k, t, _ in got] == [(k, t) for k, t, _ in want]
    assert got == want


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, columns named as the stages name theirs."""
    rows = odd(spark).withColumn("n_tokens", F.lit("mine")).withColumn("decoded", F.lit("own"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, (1, 1, 0), (2, None, None), (None, 1, 1), (1, 0, 1)).write.parquet(f"{tmp_path}/labels.parquet")
    given = docs = table(spark, str(tmp_path), "documents")
    counts = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        counts[name] = docs.count()
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == given.columns
    assert counts["toxicity"] == counts["line dedup"] == 9
    assert counts["MinHash near-dedup"] == 6
    got = docs.collect()
    assert docs.columns == [c for c in given.columns if c not in ("ids", "n_tokens")] + ["n_tokens", "ids"] and {r["decoded"] for r in got} <= {"own"}
    assert {r["doc_id"] for r in got} <= {None, 1, 4, 6} and all(len(r["ids"]) == 4 * r["n_tokens"] > 0 for r in got)
    every = {r["doc_id"]: r for r in pipeline.tokenise(spark, given, str(tmp_path)).collect()}
    assert (every[2]["text"], every[2]["n_tokens"], every[3]["text"], every[3]["n_tokens"]) == (None, 0, "", 0)
    assert len(DOC.split(", ")) + 2 == len(given.columns)
