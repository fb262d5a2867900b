import io
import json
import os
import time
import zipfile
import zlib

import pytest

from pyspark.sql import functions as F

from quire.operators import memory as Y
from quire.sources import files as R
from quire.sources.providers import EchoProvider, answered
from quire.streaming import jobs as J


def write(folder, name, *rows):
    """A file of a log, older than those written later, by which a stream takes them in order."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    at = 1_700_000_000 + 10 * int(name.partition(".")[0])
    os.utime(folder / name, (at, at))


def event(kind, paper, minute):
    return {"event": kind, "paper_id": paper, "attempt": 1, "at": f"2026-01-01T0{minute // 60}:{minute % 60:02d}:00Z"}


def drained(spark, df, folder, mode="append"):
    q = df.writeStream.format("memory").queryName("t_out").outputMode(mode).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = [r.asDict() for r in spark.sql("select * from t_out").collect()]
    spark.catalog.dropTempView("t_out")
    return out


def test_pairs_on_a_stream(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "1.json", event("conversion-started", "a", 0), event("conversion-started", "b", 1), event("conversion-finished", "a", 5))
    write(log, "2.json", event("conversion-started", "z", 300), event("conversion-finished", "z", 301))
    write(log, "3.json", event("conversion-started", "y", 400), event("conversion-finished", "y", 401))
    stream = spark.readStream.schema(J.JOBS).option("maxFilesPerTrigger", 1).json(str(log))
    got = {r["paper_id"]: r["finished_at"] is not None for r in drained(spark, J.pairs(stream), tmp_path)}
    assert got["a"] is True and got["z"] is True


def test_pairs_long_after_the_start(spark, tmp_path):
    """A finish counts within the horizon, however late it is; past it the start comes out alone."""
    log = tmp_path / "log"
    write(log, "1.json", event("conversion-started", "a", 0), event("conversion-started", "b", 1))
    write(log, "2.json", event("conversion-finished", "a", 300), event("conversion-started", "z", 301), event("conversion-finished", "z", 302))
    write(log, "3.json", event("conversion-started", "y", 590), event("conversion-finished", "y", 591))
    write(log, "4.json", event("conversion-started", "x", 595), event("conversion-finished", "x", 596))
    stream = spark.readStream.schema(J.JOBS).option("maxFilesPerTrigger", 1).json(str(log))
    got = {r["paper_id"]: r["finished_at"] is not None for r in drained(spark, J.pairs(stream, "10 minutes", "6 hours"), tmp_path)}
    assert got["a"] is True and got["b"] is False and got["z"] is True


def test_stale_timer_and_sessions(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "1.json", event("conversion-started", "a", 0), event("conversion-started", "b", 1), event("conversion-finished", "a", 2))
    write(log, "2.json", event("conversion-started", "z", 300))
    write(log, "3.json", event("conversion-finished", "z", 301))
    stream = spark.readStream.schema(J.JOBS).option("maxFilesPerTrigger", 1).json(str(log))
    assert {r["paper_id"] for r in drained(spark, J.stale(stream, 600), tmp_path / "s")} == {"b"}
    runs = tmp_path / "runs"
    row = lambda run, minute: {"event": "paper-started", "run_id": run, "at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}
    write(runs, "1.json", row("r", 0), row("r", 3), row("r", 20), row("q", 1))
    write(runs, "2.json", row("r", 500))
    write(runs, "3.json", row("r", 501))
    stream = spark.readStream.schema(J.RUNS).option("maxFilesPerTrigger", 1).json(str(runs))
    got = sorted((r["run_id"], r["n"]) for r in drained(spark, J.sessions(stream), tmp_path / "t"))
    assert got[:3] == [("q", 1), ("r", 1), ("r", 2)]


def test_progress_is_told(spark, tmp_path):
    told = []
    listener = J.Progress(lambda name, details: told.append((name, details.get("count"))))
    spark.streams.addListener(listener)
    try:
        log = tmp_path / "log"
        write(log, "1.json", event("conversion-started", "a", 0))
        drained(spark, J.job_log(spark, str(log)), tmp_path)
        for _ in range(50):
            if told and told[-1][0] == "run-finished":
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told[0][0] == "run-started" and told[-1][0] == "run-finished" and ("stage-progress", 1) in told


def test_windows_on_a_stream(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "1.json", event("paper-started", "a", 0), event("paper-started", "a", 3), event("paper-started", "a", 12))
    write(log, "2.json", event("paper-started", "a", 500))
    stream = spark.readStream.schema(J.JOBS).option("maxFilesPerTrigger", 1).json(str(log))
    got = drained(spark, J.activity(stream), tmp_path)
    assert sorted(r["n"] for r in got)[:2] == [1, 2]


def test_versioned_upsert(spark, tmp_path):
    log, table = tmp_path / "log", str(tmp_path / "state")
    schema = "scope string, key string, stale boolean, reason string, updated_at int"

    def merge(before, batch):
        return batch if before is None else Y.upsert_state(before, batch)

    for turn, (key, at) in enumerate([("p", 1), ("q", 2), ("p", 3)]):
        write(log, f"{turn}.json", {"scope": "paper", "key": key, "stale": True, "reason": f"r{at}", "updated_at": at})
        q = J.each_new(spark.readStream.schema(schema).json(str(log)), J.versioned_upsert(spark, table, merge), str(tmp_path / "c"))
        q.awaitTermination()
    assert {r["key"]: r["reason"] for r in J.latest(spark, table).collect()} == {"p": "r3", "q": "r2"}


def test_records_and_json(spark, tmp_path):
    for place, text in (("inbox/a", '{"id": "i1", "name": "A", "status": {"conversion": "done"}}'), ("collections/x/b", "[1"), ("elsewhere/c", '{"id": "no"}')):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "paper.yaml").write_text(text)
    got = {r["bundle_path"]: (r["id"], r["_corrupt"]) for r in R.records(spark, str(tmp_path)).collect()}
    assert got == {"inbox/a": ("i1", False), "collections/x/b": (None, True)}
    values = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{bad",), (None,)], "t string").select(R.json_value(F.col("t")).alias("v"))
    assert [r["v"] for r in values.collect()] == ['{"a":1}', '{"value":[1]}', '{"error":"invalid-json"}', None]


def test_archives_and_pages(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("b/full.md", "# B")
        z.writestr("a.md", "# A")
        z.writestr("x.png", "p")
    df = spark.createDataFrame([(1, raw.getvalue()), (2, b"broken"), (3, None)], "k int, content binary")
    entries = R.zip_entries(df, "k")
    assert entries.where("error is null").count() == 3 and {r["k"] for r in entries.where("error is not null").collect()} == {2, 3}
    assert R.archive_markdown(entries, "k").first()["markdown"] == "# A"
    placed = {(r["k"], r["entry"]): r["target"] or r["error"] for r in R.normalised_bundle(entries, "k").collect()}
    assert placed[1, "a.md"] == "paper.md" and placed[1, "b/full.md"] == "raw/full.md" and placed[1, "x.png"] == "raw/x.png" and "broken" in placed[2, None]
    packed = b"4 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + zlib.compress(b"<< /Type /Pages /Kids [] /Count 12 >> << /Type /Page >>") + b"\nendstream"
    rows = [(1, b"%PDF /Type /Page /Type /Pages /Type/Page"), (2, b"no"), (3, packed + rb" << /Title (Lakes \(deep\)\041) /Author <FEFF004C0069> >>"), (4, None), (5, b"1 0 obj << /Type /Pages /Count 3 >> 2 0 obj << /Type /Pages /Count 1 >>")]
    got = {r["k"]: r for r in R.pdf_info(spark.createDataFrame(rows, "k int, content binary"), "k").collect()}
    assert {k: r["pages"] for k, r in got.items()} == {1: 2, 2: None, 3: 12, 4: None, 5: 3}
    assert (got[3]["title"], got[3]["author"], got[2]["title"]) == ("Lakes (deep)!", "Li", None)


def test_pdf_discovery(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.pdf", "d/b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert R.pdf_files(spark, str(tmp_path)).count() == 2


def test_provider_errors_are_rows(spark):
    class Fails:
        def complete(self, messages, schema_name):
            raise RuntimeError("no")

    df = spark.createDataFrame([("1", json.dumps({"blocks": [{"block_id": "b", "text": "t"}]}))], "request_id string, messages string")
    assert json.loads(answered(df, EchoProvider(), "block-summary", at_once=2).first()["answer"])["blocks"][0]["summary_text"] == "t"
    assert answered(df, Fails(), "block-summary", wait=0).first()["error"] == "no"


def test_sinks(spark, tmp_path):
    from quire.sources import sinks as K

    K.init_library(spark, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/memory_state").count() == 0
    root = spark.range(1).select(K.collection_root(F.lit("a//./../b/")).alias("x"), K.memory_folder(F.lit("__root__")).alias("y")).first()
    assert (root["x"], root["y"]) == ("a/b", "_memory/collections/__root__")
    target, history = f"{tmp_path}/t", f"{tmp_path}/h"
    K.write_version(spark.createDataFrame([(1, "a"), (2, "x")], "k int, v string"), target)
    for value in ("b", "c"):  # each made from the stored table itself
        stored = K.latest(spark, target)
        new = K.upserted(stored, stored.where("k = 1").withColumn("v", F.lit(value)), "k")
        K.replace_with_history(new, stored.where("k = 1"), target, history, F.lit("now"))
    assert {(r["k"], r["v"]) for r in K.latest(spark, target).collect()} == {(1, "c"), (2, "x")}
    assert sorted(r["v"] for r in spark.read.parquet(history).collect()) == ["a", "b"]


def test_files_are_replaced_as_a_whole(spark, tmp_path):
    from quire.sources import sinks as K

    K.write_text(spark, f"{tmp_path}/a/x.md", "one")
    K.write_text(spark, f"{tmp_path}/a/x.md", "twö")
    assert (tmp_path / "a" / "x.md").read_text() == "twö" and [p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".tmp"] == []
    rows = spark.createDataFrame([("inbox/p/paper.yaml", '{"id": "i1"}'), ("inbox/q/paper.yaml", None)], "path string, text string")
    K.write_files(rows, str(tmp_path / "lib"))
    assert (tmp_path / "lib/inbox/p/paper.yaml").read_text() == '{"id": "i1"}'
    spark.dataSource.register(R.RecordSource)
    got = {r["path"].rpartition("/inbox/")[2]: r["json"] for r in spark.read.format("quire-records").load(str(tmp_path / "lib")).collect()}
    assert got == {"p/paper.yaml": '{"id": "i1"}', "q/paper.yaml": None}
    assert [r["id"] for r in R.record_ids(spark, str(tmp_path / "lib")).collect()] == ["i1"]
    n = K.publish(spark, {"summary": rows, "source_map": rows.limit(1)}, str(tmp_path / "out"))
    assert K.versions(spark, str(tmp_path / "out")) == [n] and spark.read.parquet(f"{tmp_path}/out/v={n:09d}/summary").count() == 2
    K.append_events(spark.createDataFrame([("e",)], "event string"), f"{tmp_path}/log", 0)
    K.append_events(spark.createDataFrame([("e",)], "event string"), f"{tmp_path}/log", 0)
    assert spark.read.json(f"{tmp_path}/log").count() == 1


def test_strict_json_and_numbered_lines(spark, tmp_path):
    one = lambda text: spark.createDataFrame([(text,)], "t string").select(R.json_object(F.col("t")).alias("v")).first()["v"]
    assert one('{"a": 1}') == '{"a":1}'
    for bad in ("[1]", "{bad", None):
        with pytest.raises(Exception, match="not a JSON object"):
            one(bad)
    (tmp_path / "jobs.jsonl").write_text('{"a": 1}\n\n{bad\n')
    rows = [(r["number"], r["line"]) for r in R.numbered_lines(spark, str(tmp_path / "jobs.jsonl")).orderBy("number").collect()]
    assert rows[0] == (1, '{"a": 1}') and rows[2] == (3, "{bad")
    R.append_log(spark.createDataFrame([("x",)], "event string"), f"{tmp_path}/log")
    R.rebuild(spark.createDataFrame([("y",)], "event string"), f"{tmp_path}/log")
    assert [r["event"] for r in R.log(spark, f"{tmp_path}/log", "event string").collect()] == ["y"]


def test_yaml_records(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "inbox/a").mkdir(parents=True)
    (tmp_path / "inbox/a/paper.yaml").write_text("id: i1\nname: A b\nmetadata:\n  title: 'x: y'\n  year: 2001\n")
    r = R.records(spark, str(tmp_path)).first()
    assert (r["id"], r["metadata"]["title"], r["metadata"]["year"], r["_corrupt"]) == ("i1", "x: y", 2001, False)
