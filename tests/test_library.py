from datetime import datetime

from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import doctor as D
from quire.operators import ingest as I
from quire.operators import library as L

PAPER = "id string, name string, bundle_path string, title string, conversion string, metadata_status string, n_previous_names int, has_markdown boolean, has_pdf boolean, collection string"


def papers(spark):
    rows = [
        ("sha256:one", "Example One", "collections/a b/x", "First", "done", "complete", 0, True, True, "a b"),
        ("sha256:two", "Example Two", "collections/a/x", "Second", "failed", None, 1, True, False, "a"),
        ("sha256:two", "Other", "inbox/y", None, None, "partial", 0, False, True, None),
        ("sha256:four", "Fourth", "inbox/z", "Paper of example", "done", "complete", 2, False, True, None),
    ]
    return spark.createDataFrame(rows, PAPER)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_status(spark):
    assert L.status(papers(spark)).first().asDict() == {"total": 4, "converted": 2, "failed": 1, "pending": 1, "incomplete_metadata": 2, "renamed": 2}


def test_path_order_is_by_component(spark):
    assert [r["bundle_path"] for r in L.in_path_order(papers(spark)).collect()][:2] == ["collections/a/x", "collections/a b/x"]


def test_resolve_and_ambiguity(spark):
    found = L.resolve(papers(spark), "Example")
    assert {r["name"]: r["reasons"] for r in found.collect()} == {"Example One": ["name-substring"], "Example Two": ["name-substring"], "Fourth": ["title-substring"]}
    assert L.resolved_one(found).first()["verdict"] == "ambiguous"
    assert L.resolved_one(L.resolve(papers(spark), "sha256:one")).first()["verdict"] == "found"
    assert L.resolve(papers(spark), "  ").count() == 0


def test_the_three_predicates_differ(spark):
    p = papers(spark)
    assert p.where(L.extract_match("example")).count() == 0
    assert p.where(L.repair_match("example")).count() == 2
    assert p.where(L.repair_collection("collections/a/")).count() == 1
    assert p.where(L.repair_collection("inbox")).count() == 2
    assert L.candidates(p, F.lit(True), 0).count() == 1


def test_collection_names(spark):
    assert one(spark, L.memory_collection(F.lit("collections/x/y/_memory/collection-memory.json"))) == "x/y"
    assert one(spark, L.memory_collection(F.lit("collections/"))) == "__root__"
    assert one(spark, L.memory_collection(F.lit(" / "))) == ""
    assert one(spark, L.collection_key(F.lit(None).cast("string"), F.lit("collections/x/y/p"))) == "x/y"
    assert one(spark, L.collection_key(F.lit(None).cast("string"), F.lit("inbox/p"))) == "__root__"


def test_doctor(spark):
    assert [r["path"] for r in D.duplicate_ids(papers(spark)).collect()] == ["inbox/y"]
    jobs = spark.createDataFrame([("conversion-started", "p", 1), ("conversion-started", "p", 1), ("conversion-started", None, None), ("conversion-finished", "", 0), ("conversion-finished", "q", 1)], "event string, paper_id string, attempt int")
    assert D.dangling_jobs(jobs).count() == 2
    conversions = spark.createDataFrame([("a", "running", "batch-api", None, "d", "2026-01-01T00:00:00Z"), ("b", "running", "local", None, None, "nonsense"), ("c", "done", "batch-api", None, None, None)], "bundle_path string, state string, converter string, batch_id string, data_id string, submitted_at string")
    now = F.lit(datetime(2026, 1, 1, 1)).cast("timestamp")
    assert {(r["code"], r["path"][0]) for r in D.running_issues(conversions, now).collect()} == {("missing-batch-conversion-mapping", "a"), ("stale-running-conversion", "a"), ("invalid-conversion-timestamp", "b")}
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, "{bad"), (3, " ")], "number int, line string")
    assert [r["path"] for r in D.corrupt_lines(lines, "jobs.jsonl").collect()] == ["jobs.jsonl:2"]


def test_text_functions(spark):
    assert one(spark, T.strip(F.lit(" \t x  y\n "))) == "x  y"
    assert one(spark, T.file_name(F.lit("on/off: a|b?"))) == "on-off- a-b"
    assert one(spark, T.file_name(F.lit(" red   blue  "), 6)) == "red bl"
    assert one(spark, T.file_name(F.lit("..."))) == "untitled"
    assert one(spark, T.ascii_slug(F.lit("Müller Γ-decay: café <n=7> & more"))) == "muller-gamma-decay-cafe-n-7-more"
    assert one(spark, T.language(F.lit("湖水"))) == "zh-CN"


def test_metadata_functions(spark):
    got = one(spark, M.from_file_name(F.lit("Okafor et al. - 2019 - Tides of small lakes")))
    assert (got["creator"], got["year"], got["title"]) == ("Okafor", 2019, "Tides of small lakes")
    assert one(spark, M.from_file_name(F.lit("scan_0017")))["title_source"] == "filename-stem"
    assert [c["name"] for c in one(spark, M.creators(F.lit("R. Osei; M.K. Vogt and Tan Yi")))] == ["R. Osei", "M.K. Vogt", "Tan Yi"]
    assert [c["name"] for c in one(spark, M.creators(F.lit("Ann Lee et al.; Bo")))] == ["Ann Lee", "Bo"]
    assert one(spark, M.display_name(F.lit("Li"), F.lit(2020), F.lit("T  x"), F.lit("en"))) == "Li et al. - 2020 - T x"
    assert one(spark, M.display_name(F.lit("Li"), F.lit(None).cast("int"), F.lit("T"), F.lit("zh-CN"))) == "Li - T"
    assert one(spark, M.bad_converted_title(F.lit("x"), F.lit("SOME VERY LONG TITLE IN CAPITALS \\"))) is True
    assert one(spark, M.bad_converted_title(F.lit(""), F.lit("SOME VERY LONG TITLE IN CAPITALS"))) is False
    assert one(spark, M.creator_before_title(F.lit("Smith – Big title"), F.lit("Big title"))) == "Smith"
    assert one(spark, M.first_doi(F.lit("see 10.5555/lake.7)."))) == "10.5555/lake.7"


def test_page_parts(spark):
    df = spark.createDataFrame([(1, 400), (2, 343), (3, 10), (4, None)], "paper_id int, pages int")
    got = [(r["paper_id"], r["page_start"], r["page_end"]) for r in I.page_parts(df, 195).orderBy("paper_id", "part").collect()]
    assert got[:6] == [(1, 1, 195), (1, 196, 390), (1, 391, 400), (2, 1, 195), (2, 196, 343), (3, 1, 10)]


def test_merge_reports_the_first_failed_part(spark):
    df = spark.createDataFrame([(1, 1, True, None, "a"), (1, 3, False, "third", "c"), (1, 2, False, "second", "b"), (2, 2, True, None, "![](images/x.png)"), (2, 1, True, None, "one")], "paper_id int, part int, ok boolean, error string, markdown string")
    got = {r["paper_id"]: r for r in I.merge_parts(df).collect()}
    assert (got[1]["ok"], got[1]["error"], got[1]["markdown"]) == (False, "second", None)
    assert got[2]["markdown"] == "<!-- part 1 -->\none\n\n<!-- part 2 -->\n![](images/part-002/x.png)\n"


def test_import_takes_the_first_path_once(spark):
    files = spark.createDataFrame([("i1", "b/x"), ("i1", "a/x"), ("i2", "c")], "id string, path string")
    got = {r["path"]: r["action"] for r in I.import_plan(files, spark.createDataFrame([("i2",)], "id string")).collect()}
    assert got == {"b/x": "skip", "a/x": "import", "c": "skip"}


def test_unique_names_are_greedy(spark):
    items = spark.createDataFrame([("r", "X", "1"), ("r", "X-2", "2"), ("r", "X", "3"), ("r", "X", "4"), ("s", "X", "5")], "root string, name string, path string")
    got = {r["path"]: r["unique_name"] for r in I.unique_names(items).collect()}
    assert got == {"1": "X", "2": "X-2", "3": "X-3", "4": "X-4", "5": "X"}


def page_authors(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, markdown string")
    return [r["authors_line"] for r in I.with_title_page_authors(df).orderBy("k").collect()]


def test_title_page_authors(spark):
    got = page_authors(
        spark,
        "# On lakes\n\nAnn Lee, Bo Li,\nCy Do and Di Fu\n\nUniversity of X\n\ntext, with commas and such",
        "# On lakes\nDepartment of Y, Z",
        "",
        None,
        "# 湖水\n\n李明, 王芳\n\n某大学",
        "Li, Bo\n# On lakes\n\nshort\n\nAnn Lee and Bo Li",
        "# On lakes\n\n## Part\n\nA1, B2, C3\n\n" + "x, " * 100,
        "no title, but commas",
        "#\n\nstill, no title",
    )
    assert got == ["Ann Lee, Bo Li, Cy Do and Di Fu", None, None, None, "李明, 王芳", "Ann Lee and Bo Li", None, "no title, but commas", "still, no title"]


def test_ranks_over_all_partitions(spark):
    df = spark.range(1000).repartition(7).select(F.col("id").alias("k"))
    got = I.chunks(df, 30, F.col("k").desc()).collect()
    assert {r["k"]: r["chunk"] for r in got} == {k: (999 - k) // 30 for k in range(1000)}


def test_many_equal_names(spark):
    items = spark.range(3000).select(F.lit("r").alias("root"), F.lit("untitled").alias("name"), F.format_string("%05d", "id").alias("path"))
    got = {r["path"]: r["unique_name"] for r in I.unique_names(items, existing=spark.createDataFrame([("r", "untitled-3")], "root string, name string")).collect()}
    assert got["00000"] == "untitled" and got["00001"] == "untitled-2" and got["00002"] == "untitled-4" and len(set(got.values())) == 3000


def test_merging_metadata_in_a_row(spark):
    from quire.operators import convert as C

    detail = "metadata struct<title:string,creators:array<struct<name:string,role:string>>,year:int,language:string,doi:string>, sources map<string,string>, confidence map<string,string>"
    rows = spark.createDataFrame([(("Ann Lee - Deep lakes", [], 1999, "en", None), {"title": "filename"}, {"title": "medium", "year": "high"}, ("Deep lakes", None, 2001, "en", "10.5555/x"), {"title": "converted", "doi": "converted"}, {"title": "high", "year": "medium", "doi": "high"})], ", ".join(x.replace("metadata", f"{p}m").replace("sources", f"{p}s").replace("confidence", f"{p}c") for p, x in (("o", detail), ("n", detail))))
    of = lambda p: F.struct(F.col(f"{p}m").alias("metadata"), F.col(f"{p}s").alias("sources"), F.col(f"{p}c").alias("confidence"))
    got = rows.select(C.merged_details(of("o"), of("n")).alias("d")).first()["d"]
    assert (got["metadata"]["title"], got["metadata"]["year"], got["metadata"]["doi"], got["metadata"]["creators"][0]["name"]) == ("Deep lakes", 1999, "10.5555/x", "Ann Lee")
    assert got["sources"] == {"title": "converted", "creators": "filename-title-prefix", "doi": "converted"} and got["confidence"]["title"] == "high"
