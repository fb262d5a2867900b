"""Sources and sinks of a document library: records, JSON, logs, archives, artifacts."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:
    import yaml
except ImportError:  # records are then read as JSON, which is YAML too
    yaml = None

RECORD = """schema_version INT, id STRING, name STRING, name_locked BOOLEAN, previous_names ARRAY<STRING>, collection STRING,
metadata STRUCT<title STRING, creators ARRAY<STRUCT<name STRING, role STRING>>, year INT, language STRING, doi STRING, arxiv STRING>,
metadata_sources MAP<STRING,STRING>, metadata_confidence MAP<STRING,STRING>, status STRUCT<import STRING, conversion STRING, metadata STRING, naming STRING>"""


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, id, bytes of all PDF files below a path; ids are hashes of the content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("id"), F.col("length").alias("bytes"))


def whole_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, text of all files of a name below a path."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _parsed(text: str | None) -> str | None:
    """A record in YAML as JSON, or nothing where it is no mapping."""
    try:
        value = yaml.safe_load(text) if yaml else json.loads(text)
    except Exception:  # noqa: BLE001  whatever a bad file raises, it is a bad file
        return None
    return json.dumps(value, default=str) if isinstance(value, dict) else None


def records(spark: SparkSession, library: str) -> DataFrame:
    """bundle_path, the record's columns and _corrupt, of all record files below inbox and collections."""

    def to_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_parsed(t) for t in b.column(1).to_pylist()], pa.string())], ["path", "json"])

    texts = whole_texts(spark, library, "paper.yaml").where(F.col("path").rlike(r"/(inbox|collections)/"))
    rows = texts.mapInArrow(to_json, "path string, json string").withColumn("r", F.from_json("json", RECORD))
    bundle = F.regexp_replace(F.regexp_extract("path", r".*/((?:inbox|collections)/.*)", 1), r"/paper\.yaml\z", "")
    return rows.select(bundle.alias("bundle_path"), "r.*", (F.col("json").isNull() | F.col("r.id").isNull()).alias("_corrupt"))


def record_ids(spark: SparkSession, library: str) -> DataFrame:
    """id of all records anywhere in a library, each once; what can't be read is left out."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.loads(x).get("id") for x in map(_parsed, b.column(1).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([str(x) for x in found if x], pa.string())], ["id"])

    return whole_texts(spark, library, "paper.yaml").mapInArrow(ids, "id string").distinct()


def record_text(record: Column) -> Column:
    """A record as the text of its file.  JSON is YAML too, so readers of either take it."""
    return F.concat(F.to_json(record, {"ignoreNullFields": "false"}), F.lit("\n"))


def json_object(text: Column) -> Column:
    """A JSON text as text of an object; anything else is an error."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), F.to_json(F.try_parse_json(text))).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring(F.coalesce(text, F.lit("null")), 1, 80))))


def json_or_empty(text: Column, name: Column) -> Column:
    """A JSON text as text of an object: what is missing or no object is {}, what isn't JSON {"error": ...} with the file's name."""
    parsed = F.try_parse_json(text)
    found = F.when(F.schema_of_variant(parsed).startswith("OBJECT"), F.to_json(parsed))
    return F.when(text.isNotNull() & parsed.isNull(), F.to_json(F.struct(F.concat(F.lit("invalid JSON in "), name).alias("error")))).otherwise(F.coalesce(found, F.lit("{}")))


def json_value(text: Column) -> Column:
    """A JSON text as text of an object: what isn't JSON becomes {"error": ...}, what isn't an object {"value": ...}."""
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    return F.when(text.isNull(), None).when(parsed.isNull(), F.to_json(F.struct(F.lit("invalid-json").alias("error")))).when(kind.startswith("OBJECT"), F.to_json(parsed)).otherwise(F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, number, line: of log files, numbered from 1 within each."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    return rows.select("path", (F.col("i") + 1).alias("number"), "line")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines with _corrupt_record for lines that don't parse."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("mode", "PERMISSIVE").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rebuild(rows: DataFrame, path: str) -> None:
    """Writes a derived table anew; Spark's committer makes that all or nothing."""
    rows.write.mode("overwrite").json(path)


def zip_entries(archives: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, entry, bytes, text (of Markdown only), error: the files in each archive; a broken one is a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                            data = z.read(name)
                            rows.append((k, name, len(data), data.decode("utf-8", "replace") if name.endswith(".md") else None, None))
                except (zipfile.BadZipFile, RuntimeError, zipfile.zlib.error) as e:
                    rows = [(k, None, None, None, f"broken archive: {e}")]
                out = pd.DataFrame(rows, columns=[key, "entry", "bytes", "text", "error"])
                yield out.astype({"bytes": "Int64"})

    kind = archives.schema[key].dataType.simpleString()
    return archives.select(key, content).mapInPandas(run, f"`{key}` {kind}, entry string, bytes long, text string, error string")


def archive_markdown(entries: DataFrame, key: str) -> DataFrame:
    """key, markdown: of the first Markdown file of each archive, in order of names."""
    return entries.where("entry like '%.md'").groupBy(key).agg(F.min_by("text", F.split("entry", "/")).alias("markdown"))


def normalised_bundle(entries: DataFrame, key: str) -> DataFrame:
    """key, entry, target, error: where each file of an archive goes in a bundle.

    The first Markdown file is paper.md; files below a folder images keep their place
    below it; the others go to raw, by their name or, if one before has it, by their
    whole path.  An archive without Markdown is one row with an error.
    """
    parts = F.split("entry", "/")
    first = entries.where("entry like '%.md'").groupBy(key).agg(F.min_by("entry", parts).alias("_md"))
    rows = entries.join(first, key, "left").withColumn("_at", F.array_position(parts, "images").cast("int")).withColumn("_name", F.element_at(parts, -1))
    kind = F.when(F.col("_md").isNull(), "none").when(F.col("entry") == F.col("_md"), "markdown").when((F.col("_at") > 0) & (F.col("_at") < F.size(parts)), "image").otherwise("raw")
    rows = rows.withColumn("_kind", kind)
    turn = F.row_number().over(Window.partitionBy(key, "_kind", "_name").orderBy(parts))  # files of one archive
    target = (
        F.when(F.col("_kind") == "markdown", "paper.md")
        .when(F.col("_kind") == "image", F.concat(F.lit("images/"), F.array_join(F.slice(parts, F.col("_at") + 1, F.size(parts)), "/")))
        .when(turn == 1, F.concat(F.lit("raw/"), F.col("_name")))
        .otherwise(F.concat(F.lit("raw/"), F.array_join(parts, "_")))
    )
    good = rows.where("_kind <> 'none'").select(key, "entry", target.alias("target"), F.lit(None).cast("string").alias("error"))
    bad = rows.where("_kind = 'none'").groupBy(key).agg(F.coalesce(F.max("error"), F.lit("no Markdown in the archive")).alias("error"))
    return good.unionByName(bad.select(key, F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("target"), "error"))


_PAGES = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_TREE = re.compile(rb"/Type\s*/Pages(?![A-Za-z])")
_COUNT = re.compile(rb"/Count\s+(\d+)")
_OBJECTS = re.compile(rb"/Type\s*/ObjStm.*?stream\r?\n", re.S)
_INFO = {name: re.compile(rb"/" + name + rb"\s*(?:\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>)", re.S) for name in (b"Title", b"Author")}
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
# Fixed values.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}


def _pdf_objects(raw: bytes) -> bytes:
    """A PDF's bytes and what its compressed object streams hold, as far as they can be read."""
    parts = [raw]
    for m in _OBJECTS.finditer(raw):
        try:
            parts.append(zipfile.zlib.decompressobj().decompress(raw[m.end() : raw.find(b"endstream", m.end())]))
        except zipfile.zlib.error:
            continue
    return b"\n".join(parts)


def _pdf_pages(raw: bytes) -> int | None:
    """The count of the page tree's root, which has the largest, or else the number of page objects."""
    found = _pdf_objects(raw)
    counts = [int(m[1]) for d in re.findall(rb"<<.*?>>", found, re.S) if _TREE.search(d) and (m := _COUNT.search(d))]
    return max(counts, default=0) or len(_PAGES.findall(found)) or None


def _pdf_string(literal: bytes | None, digits: bytes | None) -> str:
    if digits is not None:
        clean = re.sub(rb"\s", b"", digits)
        value = bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode())
    else:
        value = _ESCAPE.sub(lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else m[1]), literal or b"")
    return value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("latin-1")


def pdf_info(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, title, author, pages: a PDF's document information and page count, objects in compressed streams included.

    What isn't there is null; of what a file updates the last counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, raw in zip(pdf[key], pdf[content], strict=True):
                found = _pdf_objects(raw or b"")
                last = {n: (p.findall(found) or [None])[-1] for n, p in _INFO.items()}
                said = {n: None if m is None else _pdf_string(m[0] if m[0] or not m[1] else None, m[1] or None) for n, m in last.items()}
                rows.append((k, said[b"Title"], said[b"Author"], _pdf_pages(raw or b"")))
            yield pd.DataFrame(rows, columns=[key, "title", "author", "pages"]).astype({"pages": "Int32"})

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"`{key}` {kind}, title string, author string, pages int")


def page_counts(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, pages; null where a file has none that can be read."""
    return pdf_info(files, key, content).select(key, "pages")


class RecordSource(DataSource):
    """``spark.read.format("quire-records").load(path)``: path and text of record files, a partition for every ``batch`` files."""

    @classmethod
    def name(cls) -> str:
        return "quire-records"

    def schema(self) -> str:
        return "path string, json string"

    def reader(self, schema) -> DataSourceReader:
        return _RecordReader(self.options)


class _RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.batch = options["path"], int(options.get("batch", 64))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._files()
        found = []
        for top in ("inbox", "collections"):
            listed = files.get_file_info(fs.FileSelector(f"{root}/{top}", recursive=True, allow_not_found=True))
            found += [f.path for f in listed if f.is_file and f.base_name == "paper.yaml"]
        found.sort()
        return [InputPartition(found[i : i + self.batch]) for i in range(0, len(found), self.batch)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, _ = self._files()
        for p in partition.value:
            with files.open_input_stream(p) as f:
                yield p, _parsed(f.read().decode("utf-8", "replace"))
