import random
import re

from quire.operators import blocks as B
from quire.operators import findings as Q

TITLE = "# Title\n\n## Abstract\n\nThe abstract is here.\n\n$$\nx\n$$\n\n## Funding\n\nMoney from us.\n\n## References\n\n[1] A.\n"


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("paper_id", "order").select(*cols).collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "paper_id int, markdown string")


def test_source_map_of_a_paper(spark):
    found = rows(B.source_map(docs(spark, TITLE)), "type", "summary_policy", "skip_reason", "section_path", "start_line")
    assert found == [
        ("heading", "skip", "heading", [], 1),
        ("heading", "skip", "heading", ["Abstract"], 3),
        ("paragraph", "summarize", None, ["Abstract"], 5),
        ("formula", "context_only", "formula", ["Abstract"], 7),
        ("heading", "skip", "non_main_section", ["Funding"], 11),
        ("paragraph", "skip", "non_main_section", ["Funding"], 13),
        ("reference", "skip", "reference_section", ["Funding"], 15),
        ("reference", "skip", "reference_section", ["Funding"], 17),
    ]


def test_empty_and_null_documents_have_no_blocks(spark):
    assert B.split_blocks(docs(spark, "", None, " \n\t\n")).count() == 0
    assert B.source_map(docs(spark)).count() == 0


def sequential(text):
    """Blocks and sections by a plain walk, for comparison."""
    out, current, start = [], [], 0
    lines = text.split("\n")
    for n, line in enumerate([*lines, ""], 1):
        if current and (not line.strip() or line.startswith("#")):
            out.append((start, n - 1, "\n".join(current)))
            current = []
        if line.strip():
            if not current:
                start = n
            current.append(line)
    stack, refs, k, res = [], False, 0, []
    for a, z, t in out:
        s = t.strip()
        kind = "heading" if s.startswith("#") else "image" if s.startswith("![") else "formula" if s.startswith("$$") or s.endswith("$$") else "table" if all(x.lstrip().startswith("|") for x in s.split("\n")) else "paragraph"
        if kind == "heading":
            refs = bool(re.match(r"#+\s*(references|bibliography)\b", s, re.I))
        if refs:
            kind = "reference"
        if kind == "heading":
            level = len(t) - len(t.lstrip("#"))
            stack = [x for x in stack if x[0] < level]
            if t.lstrip("#").strip() and level > 1:
                k += 1
                stack.append((level, f"sec_{k:04d}", t.lstrip("#").strip()))
        res.append((a, z, t, kind, stack[-1][1] if stack else None, [x[2] for x in stack]))
    return res


def test_random_documents_equal_a_sequential_walk(spark):
    rnd = random.Random(4)
    parts = ["# A", "## B", "### C", "######## Deep", "##", "#tag", "## References", "text", "more text here", "", "", " ", "| a |", "$$", "![x](y.png)", "  ## no heading"]
    texts = ["\n".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    found = rows(B.source_map(docs(spark, *texts)), "paper_id", "start_line", "end_line", "text", "type", "section_id", "section_path")
    assert found == [(i, *b) for i, t in enumerate(texts) for b in sequential(t)]


def test_packing_closes_full_batches(spark):
    sizes = [3000, 3000, 3000, 8000, 10, *[20] * 10]
    df = spark.createDataFrame([(1, i, f"b{i}", "x" * n, "summarize") for i, n in enumerate(sizes)], "paper_id int, order int, block_id string, text string, summary_policy string")
    got = {r["block_id"]: r["batch"] for r in B.packed(df).collect()}
    assert [got[f"b{i}"] for i in range(len(sizes))] == [0, 0, 1, 2, *[3] * 8, *[4] * 3]


def finding(spark, kind, text):
    df = spark.createDataFrame([(1, "b00000", kind, text)], "paper_id int, block_id string, type string, text string")
    found = Q.classified(df).collect()
    return (list(found[0]["reasons"]), found[0]["policy"]) if found else None


def test_findings(spark):
    assert finding(spark, "paragraph", "A fine line of text.") is None
    assert finding(spark, "paragraph", "page 12") == (["page_number", "short_text_noise"], "auto_repair")
    assert finding(spark, "formula", "$$ a b c d $$") == (["spaced_letters", "math_heavy"], "review_only")
    assert finding(spark, "paragraph", "Te result " + "is long " * 50)[1] == "review_only"
    assert finding(spark, "paragraph", "we show that the we show that the end")[0] == ["repeated_phrase"]
    assert finding(spark, "image", "![](images/no.png)") == (["broken_image"], "structural_warning")
    assert finding(spark, "paragraph", "Open Access")[0] == ["front_matter_noise"]
    assert finding(spark, "paragraph", "bad � char in text")[0] == ["replacement_character"]
    assert finding(spark, "paragraph", "the years 1 9 9 9 were good")[0] == ["spaced_digits"]


def test_images_that_are_there_are_not_broken(spark):
    df = spark.createDataFrame([(1, "b0", "image", "![](images/a.png)"), (1, "b1", "image", "![](images/b.png)")], "paper_id int, block_id string, type string, text string")
    files = spark.createDataFrame([(1, "images/a.png")], "paper_id int, path string")
    assert [r["block_id"] for r in Q.classified(df, artifacts=files).collect()] == ["b1"]
