"""Queries against their SQL on odd texts: null, blank, with white space and controls of all kinds, in odd case."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.operators import memory as Y
from quire.plans.queries import ORACLES, QUERIES

TEXTS = [None, "", " ", "\n", "\n\n\n\n", " a", "a\n", "\n\n\nx\ny", "a\tb  c\r\nd", "\x0b", "\x0ba\x0b b\x0b", "\x1ca\x1f", "\u00a0", "\u00a0a\u00a0b\u00a0", "a\u2028b", "a\u2029", "\u2003", "a\u0085b", "\u3000x\u3000", "a\u200bb", "\ufeffa", "a\u00adb", "\ue000a", "a\x07b", "A - 2001 - B"]
TEXTS += ["A\n\n\n a", "\n\n\nb", "b\n\n\n", "b\n\n\n\u00a0", "\u0130\n\n\ni", "\u0130\n\n\ni\u0307", "\u0391\u03a3\n\n\n\u03b1\u03c2", "\u0391\u03a3\n\n\n\u03b1\u03c3", "\u0391\u03a3 \u03b1\u03c2 \u03b1\u03c3 \u0130 i", "\u00c9\n\n\n\u00e9", " w\u00a0 w  w W \x0bw"]
LABELS = [None, "", " ", "\u00a0", " x ", "X", "\u00a0x", "\u0130", "i\u0307", "i", "\u0391\u03a3", "\u03b1\u03c2", "\u03b1\u03c3", "\x0bv"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Every text by each remainder of 5 that a key can have, negative keys, and a row without a key."""
    folder = tmp_path_factory.mktemp("odd")
    texts = [t for t in TEXTS for _ in range(5)] + ["x\ny\nz\nu"]
    ids = [*range(-9, len(texts) - 10), None]
    documents = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": ["src1"] * len(ids), "n_chars": [len(t or "") for t in texts]}
    part = {"p_partkey": list(range(3000)), "p_name": [LABELS[i // 200 % len(LABELS)] for i in range(3000)]}
    pq.write_table(pa.table(documents), folder / "documents.parquet")
    pq.write_table(pa.table(part), folder / "part.parquet")
    return str(folder)


def compared(name: str, spark, folder: str):
    """Rows of the query and of its SQL, nulls apart from blanks."""
    c = duckdb.connect()
    for table in ("documents", "part"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = c.sql(ORACLES[name])
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(QUERIES[name](spark, folder).select(*want.columns).collect()), order(want.fetchall())


@pytest.mark.parametrize("name", ["filename_metadata", "overview", "paper_memory"])
def test_odd_texts(name, spark, odd):
    got, want = compared(name, spark, odd)
    assert got == want


def test_file_names_with_line_separators(spark):
    got = spark.range(1).select(M.from_file_name(F.lit("Lee - 2001 - a\u2028b")).alias("m")).first()["m"]
    assert (got["creator"], got["title"], got["title_source"]) == ("Lee", "a\u2028b", "filename")


def test_overview_of_a_paper_without_key(spark):
    sections = spark.createDataFrame([(None, 0, "a"), (None, 1, "A"), (1, 0, " ")], "paper_id int, pos int, summary string")
    blocks = spark.createDataFrame([(None, 0, "x"), (1, 0, "y"), (2, 0, " z ")], "paper_id int, order int, summary_text string")
    assert {r["paper_id"]: r["overview"] for r in Y.overview(sections, blocks).collect()} == {None: "a", 1: "", 2: "z"}
    assert Y.overview(sections, blocks).count() == 3


def test_first_distinct_of_each_block(spark):
    """The first 12 of a paper, whatever blocks they stand in."""
    words = [[f"w{i % 9}" for i in range(40)] + ["W1", "late"], ["", "W3", *(f"v{i}" for i in range(30))], [None, "u"]]
    blocks = spark.createDataFrame([(1, i, f"b{i}", "s", "t", "other", "low", w) for i, w in enumerate(words)], "paper_id int, order int, block_id string, section_id string, summary_text string, role string, importance string, concepts array<string>")
    sections = spark.createDataFrame([(1, "s", 0, "t", "other")], "paper_id int, section_id string, pos int, summary string, role string")
    nodes = spark.createDataFrame([], "paper_id int, pos int, id string, type string, label string")
    assert Y.paper_memory(sections, blocks, nodes).first()["concepts"] == [*(f"w{i}" for i in range(9)), "late", "v0", "v1"]
