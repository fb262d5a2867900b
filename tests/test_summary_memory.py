from quire.operators import memory as Y
from quire.operators import repair as P
from quire.operators import summary as S
from quire.plans.extraction import extract


def test_responses_are_checked(spark):
    allowed = spark.createDataFrame([(1, "b1"), (1, "b2"), (1, "b3")], "paper_id int, block_id string")
    response = spark.createDataFrame([(1, "b1", " text ", None, "", ["c"]), (1, "b2", " ", "method", "high", None), (1, "bx", "t", None, None, None)], "paper_id int, block_id string, summary_text string, role string, importance string, concepts array<string>")
    got = {r["block_id"]: r for r in S.normalised_blocks(response, allowed).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {"b1": "kept", "b2": "empty", "bx": "unknown"}
    assert (got["b1"]["summary_text"], got["b1"]["role"], got["b1"]["importance"]) == ("text", "other", "medium")
    kept = S.normalised_blocks(response, allowed).where("verdict = 'kept'")
    assert sorted(r["block_id"] for r in S.missing_blocks(allowed, kept).collect()) == ["b2", "b3"]


def test_graph_keeps_traceable_parts(spark):
    known = spark.createDataFrame([(1, "b1")], "paper_id int, block_id string")
    node = "paper_id int, pos int, id string, type string, label string, source_block_ids array<string>"
    nodes = S.valid_nodes(spark.createDataFrame([(1, 0, "n1", "concept", "c", ["b1"]), (1, 1, "n2", "method", "m", []), (1, 2, "n3", "theory", "t", ["b1"]), (1, 3, "n4", "claim", "x", ["b9"]), (1, 4, None, "claim", "x", None)], node), known)
    assert sorted(r["id"] for r in nodes.collect()) == ["n1", "n2"]
    edges = spark.createDataFrame([(1, "n1", "n2", "uses", ["b1"]), (1, "n1", "n4", "uses", []), (1, "n1", "n2", "cites", []), (1, "n2", "n1", "limits", ["b2"])], "paper_id int, source string, target string, type string, source_block_ids array<string>")
    assert [(r["source"], r["target"]) for r in S.valid_edges(edges, nodes, known).collect()] == [("n1", "n2")]


def test_sections_fall_back_to_their_blocks(spark):
    inputs = spark.createDataFrame([(1, "sec_0001", 0, "H", ["b1"], ["a", "b", "c", "d"]), (1, "sec_0002", 5, "I", ["b2"], ["z"])], "paper_id int, section_id string, pos int, heading string, block_ids array<string>, texts array<string>")
    response = spark.createDataFrame([(1, "sec_0002", "", "method"), (1, "sec_0009", "x", None)], "paper_id int, section_id string, summary string, role string")
    got = {r["section_id"]: (r["summary"], r["role"]) for r in S.filled_sections(inputs, response).collect()}
    assert got == {"sec_0001": ("a b c", "other"), "sec_0002": ("", "method")}


def test_ordered_distinct_keeps_the_first_spelling(spark):
    df = spark.createDataFrame([(1, "B", 0), (1, " a ", 1), (1, "b", 2), (1, "", 3), (1, "A", 4)], "paper_id int, value string, pos int")
    assert Y.ordered_distinct(df, "paper_id").first()["values"] == ["B", "a"]


def test_paper_memory(spark):
    blocks = spark.createDataFrame([(1, 0, "b0", "s1", "result one", "result", "low", ["x"]), (1, 1, "b1", "s1", "Result One", "result", "high", ["X", "y"]), (2, 0, "b0", None, " only ", "other", None, [])], "paper_id int, order int, block_id string, section_id string, summary_text string, role string, importance string, concepts array<string>")
    sections = spark.createDataFrame([(1, "s1", 0, "sum", "background", ["b0"])], "paper_id int, section_id string, pos int, summary string, role string, block_ids array<string>")
    nodes = spark.createDataFrame([(1, 0, "n", "instrument", "laser", ["b0"])], "paper_id int, pos int, id string, type string, label string, source_block_ids array<string>")
    got = {r["paper_id"]: r for r in Y.paper_memory(sections, blocks, nodes).collect()}
    assert (got[1]["overview"], got[1]["research_problem"], got[1]["system_or_material"]) == ("sum", "sum", "laser")
    assert (got[1]["key_results"], got[1]["concepts"], got[1]["important_block_ids"]) == (["result one"], ["x", "y"], ["b1", "b0"])
    assert (got[2]["overview"], got[2]["key_results"]) == ("only", [])


def test_staleness_by_hash(spark):
    schema = "collection_key string, paper_id int, hash string"
    now = spark.createDataFrame([("a", 1, "h"), ("b", 1, "h"), ("c", 1, "h"), ("d", 1, "h"), ("d", 2, "h")], schema)
    then = spark.createDataFrame([("a", 1, "h"), ("b", 1, "g"), ("d", 1, "h")], schema)
    assert {r["collection_key"]: r["stale"] for r in Y.stale_by_hash(now, then).collect()} == {"a": False, "b": True, "c": False, "d": True}


def test_gates(spark):
    current = spark.createDataFrame([(1, "title", "old", "user", "high"), (1, "year", "2001", "filename", "medium")], "paper_id int, field string, value string, source string, confidence string")
    changes = spark.createDataFrame([(1, "title", "new", "high", "e"), (1, "year", "999", "high", "e"), (1, "doi", "10.1/x", "high", None), (1, "language", "en", "medium", None), (1, "pages", "3", "high", "e"), (1, "creators", "A", "low", "e")], "paper_id int, field string, new string, confidence string, evidence string")
    verdicts = P.metadata_verdicts(changes, current)
    assert {r["field"]: r["verdict"] for r in verdicts.collect()} == {"title": "user-kept", "year": "invalid", "doi": "no-evidence", "language": "accepted", "pages": "unsupported", "creators": "low-confidence"}
    assert {r["field"]: (r["value"], r["source"]) for r in P.upserted(current, verdicts).collect()} == {"title": ("old", "user"), "year": ("2001", "filename"), "language": ("en", "repair")}
    blocks = spark.createDataFrame([(1, "b0", "paragraph", "P a g e"), (1, "b1", "formula", "$$x$$"), (1, "b2", "paragraph", "page 3")], "paper_id int, block_id string, type string, text string")
    patches = spark.createDataFrame([(1, 0, "b0", "P a g e", "Page", "high", ""), (1, 1, "b0", "other", "x", "high", ""), (1, 2, "b1", "$$x$$", "y", "high", ""), (1, 3, "b2", "page 3", "", "medium", ""), (1, 4, "b0", "P a g e", "", "high", "ocr"), (1, 5, "b9", "", "", "high", "")], "paper_id int, pos int, block_id string, old_text string, new_text string, confidence string, reason string")
    verdicts = P.patch_verdicts(patches, blocks)
    assert [r["verdict"] for r in verdicts.orderBy("pos").collect()] == ["accepted", "old_text_mismatch", "protected_block", "accepted", "empty_patch", "unknown_block_id"]
    assert {r["block_id"]: r["text"] for r in P.patched(blocks, verdicts).collect()} == {"b0": "Page", "b1": "$$x$$", "b2": ""}


def test_extraction_from_end_to_end(spark):
    docs = spark.createDataFrame([(1, "# T\n\n## Method\n\nWe measure things here.\n\nAnd more things there.\n")], "paper_id int, markdown string")
    got = extract(docs)
    blocks, sections = got.blocks, got.sections
    assert [r["summary_text"] for r in blocks.orderBy("order").collect()] == ["We measure things here.", "And more things there."]
    assert [(r["heading"], len(r["block_ids"])) for r in sections.collect()] == [("Method", 2)]
