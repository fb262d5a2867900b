"""Commands from import to validation on small libraries, and the settings they go by."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.plans import commands as C
from quire.plans import extraction as X
from quire.sources import config as G
from quire.sources import providers as P

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers have no tests to import
RECORD = "id string, name string, collection string, bundle_path string, metadata struct<title:string,creators:array<struct<name:string,role:string>>,year:int,language:string,doi:string>, metadata_sources map<string,string>, metadata_confidence map<string,string>, schema_version int, name_locked boolean, previous_names array<string>, import_status string, conversion string, metadata_status string, naming_status string, source struct<type:string,imported_from:string,copied_pdf:string,imported_at:timestamp>"
MARKDOWN = "# Deep lakes\n\nAuthors: Ann Lee, Bo Li\n\n## Abstract\n\nLakes are deep, and this text says so at some length.\n\nAnother paragraph that says still more of lakes.\n"


def library(spark, tmp_path, n=3):
    (tmp_path / "in").mkdir()
    for i in range(n):
        (tmp_path / "in" / f"Li - 200{i} - Lakes {i}.pdf").write_bytes(b"%PDF << /Author (Ed Go) >> " + bytes([i]))
    (tmp_path / "in" / "A copy.pdf").write_bytes(b"%PDF << /Author (Ed Go) >> " + bytes([0]))
    return C.import_files(spark, str(tmp_path / "in"), spark.createDataFrame([], RECORD), now(), "lakes/deep")


def test_import_then_convert(spark, tmp_path):
    papers = library(spark, tmp_path)
    rows = {r["name"]: r for r in papers.collect()}
    assert len(rows) == 3 and {r["bundle_path"].rpartition("/")[0] for r in rows.values()} == {"collections/lakes/deep"}
    one = rows["Li et al. - 2001 - Lakes 1"]
    assert (one["metadata"]["year"], one["conversion"], one["metadata_sources"]["title"]) == (2001, "pending", "filename")
    assert "Ed Go" in {r["metadata"]["creators"][0]["name"] for r in rows.values()}  # the copy's name says nothing

    class Some(P.FixtureConverter):
        def convert(self, content):
            if content == b"1":
                raise RuntimeError("no text")
            return self.markdown

    stored = spark.createDataFrame(papers.collect(), papers.schema)
    files = stored.select("bundle_path", F.when(F.col("metadata.year") == 2001, "1").otherwise("0").cast("binary").alias("content"))
    previous = stored.where("metadata.year = 2001").select("bundle_path", F.lit(1).alias("attempt"))
    done = C.convert(stored, files, Some(MARKDOWN), now(), previous)
    after = {r["conversion"]: r for r in done.papers.collect()}
    assert after["failed"]["metadata"]["year"] == 2001 and after["done"]["metadata"]["title"] == "Deep lakes"
    names = sorted(r["name"] for r in done.papers.where("conversion = 'done'").collect())
    assert [n.partition(" - ")[0] for n in names] == ["Ann Lee et al."] * 2 and all(r["previous_names"] for r in done.papers.where("conversion = 'done'").collect())
    kept = {r["state"]: r for r in done.conversions.collect()}
    assert (kept["failed"]["attempt"], kept["failed"]["error"], kept["done"]["attempt"]) == (2, "no text", 1)
    events = [(r["event"], r["attempt"], r["state"]) for r in done.jobs.collect()]
    assert sorted(events) == sorted([("conversion-started", 1, "running")] * 2 + [("conversion-started", 2, "running"), ("conversion-finished", 2, "failed")] + [("conversion-finished", 1, "done")] * 2)
    assert {r["bundle_path"] for r in done.markdown.collect()} == {r["bundle_path"] for r in done.papers.where("conversion = 'done'").collect()}
    assert C.status(done.papers.withColumn("n_previous_names", F.size("previous_names"))).first()["renamed"] == 2
    plan = C.convert_plan(stored, 2, "local-command", {"converter": {"local_jobs": 9}}).collect()
    assert sorted(r["chunk"] for r in plan) == [0, 0, 1] and plan[0]["jobs"] == 3


def docs(spark):
    return spark.createDataFrame([(1, MARKDOWN), (2, MARKDOWN.replace("Lakes", "Rivers"))], "paper_id int, markdown string")


class Forgetful(P.EchoProvider):
    """Leaves the last block of each batch out, and says odd things."""

    def complete(self, messages, schema_name):
        answer = json.loads(super().complete(messages, schema_name))
        if schema_name == "block-summary" and len(answer["blocks"]) > 1:
            answer["blocks"] = [*answer["blocks"][:-1], {"block_id": "blk_x", "summary_text": "of nothing"}]
        if schema_name == "sections":
            answer["sections"].append({"section_id": "sec_9999", "summary": "of nothing"})
        if schema_name == "graph":
            answer["nodes"].append({"id": "n99", "type": "theory", "label": "", "source_block_ids": []})
        return json.dumps(answer)


def test_extraction_asks_again_for_what_is_missing(spark):
    got = C.extract_summary(docs(spark), Forgetful())
    assert {r["paper_id"]: r["n"] for r in got.blocks.groupBy("paper_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: 3}
    assert {r["status"] for r in got.status.collect()} == {"extracted"}
    said = {r["warning"] for r in got.warnings.collect()}
    assert said == {"Unknown block summary skipped: blk_x", "Unknown section skipped: sec_9999", "Graph node skipped: n99"}
    assert got.nodes.count() == 6 and got.edges.count() == 4 and got.by_block.count() == 2
    again = C.extract_summary(docs(spark), done=got.status.where("paper_id = 1"))
    assert {r["paper_id"]: r["status"] for r in again.status.collect()} == {1: "skipped", 2: "extracted"}
    assert {r["paper_id"]: (r["blocks"], r["batches"]) for r in X.planned(docs(spark)).collect()} == {1: (3, 1), 2: (3, 1)}


def test_a_provider_that_fails_fails_its_papers(spark):
    class Fails(P.EchoProvider):
        def complete(self, messages, schema_name):
            if "Rivers" in messages:
                raise ValueError("no")
            return super().complete(messages, schema_name)

    import quire.plans.extraction as E

    asked = E.answered
    try:
        E.answered = lambda *a, **k: asked(*a, **{**k, "retries": 0})
        got = C.extract_summary(docs(spark), Fails())
        assert {r["paper_id"]: r["status"] for r in got.status.collect()} == {1: "extracted", 2: "failed"}
        assert {r["paper_id"] for r in got.sections.collect()} == {1}
    finally:
        E.answered = asked
    assert C.provider_doctor(spark, P.EchoProvider()).first()["ok"] and not C.provider_doctor(spark, object()).first()["ok"]


class Answers(P.EchoProvider):
    def complete(self, messages, schema_name):
        asked = json.loads(messages)
        if schema_name == "collection":
            ids = [p["paper_id"] for p in asked["papers"]]
            return json.dumps({"overview_summary": "all of " + asked["collection_path"], "collection_themes": [{"name": "good", "summary": "s", "paper_ids": [str(i) for i in ids], "source_block_ids": []}, {"name": "bad", "paper_ids": ["gone"]}], "representative_paper_ids": ["gone", *(str(i) for i in ids)]})
        return json.dumps({"collections": [{"collection_path": f"collections/{c['collection_key']}/", "summary": "told"} for c in asked["collections"]] + [{"collection_path": "none"}]})


def test_memory_of_papers_collections_and_library(spark):
    got = C.extract_summary(docs(spark))
    papers = spark.createDataFrame([(1, "lakes", "Deep lakes"), (2, "rivers", "Rivers"), (3, "lakes", "Lost")], "paper_id int, collection_key string, title string")
    verdicts = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "missing-summary")], "paper_id int, verdict string")
    memory = C.build_memory(papers, got.sections, got.blocks, got.nodes, verdicts, Answers())
    assert memory.papers.count() == 2
    one = {r["collection_key"]: r for r in memory.collections.collect()}
    assert (one["lakes"]["overview"], one["lakes"]["themes"], one["lakes"]["representatives"], one["lakes"]["papers"], one["lakes"]["skipped"]) == ("all of lakes", ["good"], ["1"], 1, 1)
    whole = {r["collection_key"]: r for r in memory.library.collect()}
    assert (whole["rivers"]["summary"], whole["rivers"]["main_themes"], whole["rivers"]["representative_paper_ids"]) == ("told", ["good"], ["2"])
    assert sorted(r["warning"] for r in memory.warnings.collect()) == ["Skipped collection theme with unknown paper IDs: bad"] * 2 + ["Skipped unknown collection in library response: none"]
    assert memory.skipped.first()["reason"] == "missing-summary"


PAPER = "id string, name string, bundle_path string, title string, conversion string, metadata_status string, n_previous_names int, has_markdown boolean, has_pdf boolean, collection string"


def test_reading_commands(spark, tmp_path):
    papers = spark.createDataFrame([("sha256:one", "Lake One", "inbox/a", "First", "done", "complete", 0, True, True, None), ("sha256:two", "Lake Two", "inbox/b", None, None, None, 0, False, False, None)], PAPER)
    assert [r["id"] for r in C.list_papers(papers).collect()] == ["sha256:one", "sha256:two"]
    assert C.get(papers, "lake").count() == 0 and C.get(papers, "One").first()["title"] == "First" and C.resolve(papers, "lake").count() == 2
    files = spark.createDataFrame([("inbox/a/paper.md", "file", 12), ("inbox/a/images", "dir", None)], "path string, kind string, bytes long")
    texts = spark.createDataFrame([("inbox/a/conversion.json", "{bad"), ("inbox/a/extracts/summary/summary.json", '{"a": 1}')], "path string, text string")
    r = C.inspect(papers, "One", files, texts).first()
    assert r["artifacts"]["paper_md"]["bytes"] == 12 and r["artifacts"]["images_dir"]["kind"] == "dir" and not r["artifacts"]["repair_json"]["exists"] and len(r["artifacts"]) == 10
    assert (r["summary_file"], json.loads(r["conversion_file"])["error"], r["repair_file"]) == ('{"a":1}', "invalid-json", None)
    records = spark.createDataFrame([("inbox/c", True), ("inbox/a", False)], "bundle_path string, _corrupt boolean")
    facts = spark.createDataFrame([("conv", True, False, None)], "executable string, wanted boolean, exists boolean, error string")
    lines = spark.createDataFrame([(1, "{bad")], "number int, line string")
    found = C.doctor(papers, strict=True, records=records, conversion_files=texts, converters=facts, lines=lines)
    assert sorted(r["code"] for r in found.collect()) == ["invalid-conversion-json", "invalid-job-json", "invalid-paper-yaml", "missing-local-executable", "missing-original-pdf", "pending-conversion"]
    assert [json.loads(r["json"])["ok"] for r in C.emit(papers.limit(1)).collect()] == [True]


def test_repair_and_its_report(spark):
    current = spark.createDataFrame([(1, "title", "Old", "detected", "low")], "paper_id int, field string, value string, source string, confidence string")
    changes = spark.createDataFrame([(1, "title", "New", "high", "line 1"), (1, "volume", "7", "high", "x")], "paper_id int, field string, new string, confidence string, evidence string")
    blocks = spark.createDataFrame([(1, "b1", "paragraph", "p a g e", 0)], "paper_id int, block_id string, type string, text string, order int")
    patches = spark.createDataFrame([(1, 0, "b1", "p a g e", "page", "high", "ocr"), (1, 1, "b9", "", "x", "high", "")], "paper_id int, pos int, block_id string, old_text string, new_text string, confidence string, reason string")
    done = C.repair(changes, current, patches, blocks, now())
    assert done.metadata.first()["value"] == "New" and done.markdown.first()["text"] == "page"
    r = done.report.first()
    assert (r["metadata_changed"], [c["field"] for c in r["changes"]], r["metadata_warnings"], r["blocks_checked"], r["blocks_changed"], r["markdown_warnings"]) == (True, ["title"], ["volume:unsupported"], 2, 1, ["b9:unknown_block_id"])
    only = C.repair(changes, current, patches, blocks, now(), targets=("metadata",))
    assert only.markdown.first()["text"] == "p a g e" and only.report.first()["blocks_checked"] == 0


def test_validation(spark):
    from quire.operators import library as L
    from quire.sources.sinks import validation_markdown

    papers = spark.createDataFrame([("i", "n", "inbox/a", "t", "done", "complete", 0, True, True, None)], PAPER)
    none = spark.createDataFrame([], "code string, path string, message string")
    facts = C.validate(papers, papers, True, none, none, spark.createDataFrame([("inbox/a/paper.md", "file")], "path string, kind string"))
    got = {(r["section"], r["name"]): r["value"] for r in facts.collect()}
    assert (got["", "ok"], got["", "sampled"], got["Final status", "converted"], got["Artifact counts", "paper.md"]) == ("true", "1", "1", "1")
    text = validation_markdown(facts).first()["markdown"]
    assert text.startswith("# Validation report\n\n- ") and "## Final status" in text and "| paper.md | 1 |" in text
    with pytest.raises(ValueError, match="only 1"):
        L.seeded_sample(papers.withColumnRenamed("bundle_path", "path"), 2, 7, whole=True)


def test_settings(spark, tmp_path):
    assert G.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {"e": 1}}) == {"a": {"b": 9, "c": 2}, "d": {"e": 1}}
    assert G.load_config(spark, str(tmp_path)) == G.DEFAULTS
    (tmp_path / G.CONFIG_FILE).write_text('{"naming": {"sanitize": {"max_length": 9}}, "converter": {"executable": "no-such-program"}, "ai": {"model": "m"}}')
    config = G.load_config(spark, str(tmp_path))
    assert config["naming"]["sanitize"] == {"max_length": 9, "ascii_slug": False} and config["output"] == {"json": False}
    assert G.setting({"X": ""}, "X", {"k": 1}, "k", 2) == 1 and G.setting({"X": "e"}, "X", {}, "k") == "e" and G.setting({}, "X", {}, "k", 2) == 2
    assert [G.workers_for(*x) for x in ((200, 7), (16, 35), (0, 35), (16, 0))] == [7, 16, 1, 0]
    assert [G.local_jobs({"converter": {"local_jobs": j}}, a, 5) for j, a in (("auto", None), (9, None), ("3", None), (9, 2), (9, 0))] == [1, 5, 3, 2, 1]
    assert G.batch_size(500) == 50 and G.upload_url({"file_url": "u"}) == G.upload_url("u") == "u"
    for bad in ("0", "-1", "x"):
        with pytest.raises(ValueError):
            G.positive_seconds(bad)
    assert G.Deadline(None).left(5) == 5 and G.Deadline(100).left(5) == 5
    with pytest.raises(TimeoutError):
        late = G.Deadline(0.000001)
        while True:
            late.left()
    with pytest.raises(ValueError, match="LIBRARY_AI_API_KEY"):
        G.provider_config(config, {})
    assert G.provider_config(config, {"LIBRARY_AI_API_KEY": "k", "LIBRARY_AI_BASE_URL": "http://h/"}).base_url == "http://h"
    assert G.wants_local_check(config) and not G.wants_local_check(G.DEFAULTS)
    assert G.version_in("conv, version 1.22.3 (x)") == "1.22.3" and G.version_in(" odd ") == "odd" and G.version_in("") is None
    assert not G.local_converter(config).exists and G.local_converter({"converter": {"executable": sys.executable}}, probe=True).version.startswith("3.")
    got = {(r["area"], r["fact"]): r["value"] for r in G.diagnostics(spark, str(tmp_path), {"LIBRARY_AI_API_KEY": "secret"}).collect()}
    assert got["ai", "api_key_available"] == "true" and got["converter", "local_exists"] == "false" and "secret" not in str(got) and got["library", "inbox_exists"] == "false"
    (tmp_path / G.CONFIG_FILE).write_text("[1]")
    assert ("library", "config_error") in {(r["area"], r["fact"]) for r in G.diagnostics(spark, str(tmp_path), {}).collect()}


def test_converters(spark, tmp_path):
    class Batches:
        name = "batches"

        def convert_batch(self, items):
            return [(k, True, f"# {k}", None) for k, _ in items if k != "c"]

    files = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("c", b"3")], "bundle_path string, content binary")
    got = {r["bundle_path"]: (r["ok"], r["error"]) for r in P.converted_in_batches(files, Batches(), 2).collect()}
    assert got == {"a": (True, None), "b": (True, None), "c": (False, "no result")}
    command = [sys.executable, "-c", "import sys, os; open(os.path.join(sys.argv[2], 'x.md'), 'w').write('# ' + open(sys.argv[1]).read())"]
    assert P.LocalCommand(command, str(tmp_path / "s")).convert(b"text") == "# text" and list((tmp_path / "s").iterdir()) == []
    with pytest.raises(ValueError, match="no Markdown"):
        P.LocalCommand([sys.executable, "-c", "pass"], str(tmp_path)).convert(b"")


def test_run_events(spark, tmp_path):
    told = []
    run = C.Reporter("convert", lambda name, details: told.append(details))
    run.emit("run-started", path="library")
    run.emit("run-finished", ok=True)
    assert [t["event"] for t in told] == ["run-started", "run-finished"] and len({t["run_id"] for t in told}) == 1 and told[0]["path"] == "library" and told[1]["elapsed_seconds"] >= told[0]["elapsed_seconds"]
    logged = C.Reporter("convert", C.log_sink(spark, f"{tmp_path}/runs"))
    logged.emit("run-started")
    logged.emit("run-finished", ok=False)
    assert sorted(r["event"] for r in spark.read.json(f"{tmp_path}/runs").collect()) == ["run-finished", "run-started"]


def test_reports_as_markdown(spark):
    from quire.sources import sinks as K

    paper = "paper_id string, title string, bundle_path string, research_problem string, method string, key_results array<string>, important_block_ids array<string>"
    memories = spark.createDataFrame([("lakes", "All of it.", [("p1", "Deep", "inbox/p1", "why", "", ["r1", "r2"], ["b1"])], [("t", "s")], [("p2", "missing-summary")])], f"collection_key string, overview string, papers array<struct<{', '.join(x.replace(' ', ':', 1) for x in paper.split(', '))}>>, themes array<struct<name:string,summary:string>>, skipped array<struct<paper_id:string,reason:string>>")
    text = K.collection_report(memories).first()["markdown"]
    assert text.startswith("# Collection Memory: lakes\n\n## Overview\n\nAll of it.\n\n## Paper Memories\n\n### Deep\n\n- Paper ID: `p1`\n") and "- Key results: r1; r2\n- Source blocks: b1\n" in text and "- `p2`: missing-summary" in text and "Main method" not in text
    library = spark.createDataFrame([("", [("g", "s")])], "overview string, themes array<struct<name:string,summary:string>>")
    rows = spark.createDataFrame([("lakes", "m.json", 2, "told", ["a", "b"])], "collection_key string, memory_path string, paper_count int, summary string, main_themes array<string>")
    assert K.library_report(library, rows).first()["markdown"] == "# Library Memory\n\n## Collections\n\n### lakes\n\n- Memory: `m.json`\n- Papers summarized: 2\n- Summary: told\n- Main themes: a, b\n\n## Global Themes\n\n- g: s\n"
