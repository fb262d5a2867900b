"""Queries over records, files and answers of providers, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import metadata as M
from quire.functions import text as T
from quire.operators import blocks as B
from quire.operators import convert as C
from quire.operators import doctor as D
from quire.operators import findings as Q
from quire.operators import ingest as I
from quire.operators import library as L
from quire.operators import memory as Y
from quire.operators import repair as P
from quire.operators import summary as S
from quire.plans import extraction as X
from quire.plans import views as V
from quire.plans.queries import _KEY, ORACLES, _changes, _current, _hashes, _patches, _sections, joined, query
from quire.sources import config as G
from quire.sources import sinks as K
from quire.sources.files import json_or_empty

def doc() -> Column:
    return F.col("doc_id")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents")


def of_path(c: str = "path") -> Column:
    return F.regexp_extract(c, r"p(\d+)(?:/|\z)", 1).cast("long").alias("doc_id")


# Records and their files.


def _sidecars(papers: DataFrame) -> DataFrame:
    """Conversion files: objects, lists, and texts that are no JSON."""
    m = doc() % 3
    text = F.when(m == 0, F.to_json(F.struct("title"))).when(m == 1, "[1]").otherwise("{bad")
    return papers.where("conversion is not null").select(F.concat("bundle_path", F.lit("/conversion.json")).alias("path"), text.alias("text"))


@query(
    """SELECT doc_id, CAST(10 AS BIGINT) AS artifacts, CAST(has_markdown AS INT) + CAST(has_pdf AS INT) + CAST(conversion IS NOT NULL AS INT) AS existing, CASE WHEN has_markdown THEN length(name) END AS markdown_bytes,
  CASE WHEN conversion IS NOT NULL THEN CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN '[1]' ELSE 'invalid-json' END END AS conversion, CAST(NULL AS VARCHAR) AS summary FROM papers""",
    "papers",
)
def inspect_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    texts = _sidecars(papers)
    file = lambda where, name: papers.where(where).select(F.concat("bundle_path", F.lit(f"/{name}")).alias("path"), F.lit("file").alias("kind"), F.length("name").alias("bytes"))
    files = file("has_markdown", "paper.md").union(file("has_pdf", "original.pdf")).union(texts.select("path", F.lit("file"), F.length("text")))
    rows = L.inspected(papers, files, texts)
    read = F.coalesce(*(F.get_json_object("conversion_file", f"$.{k}") for k in ("title", "value", "error")))
    states = F.map_values("artifacts")
    return rows.select("doc_id", F.size("artifacts").alias("artifacts"), F.size(F.filter(states, lambda x: x["exists"])).alias("existing"), F.col("artifacts")["paper_md"]["bytes"].alias("markdown_bytes"), read.alias("conversion"), F.col("summary_file").alias("summary"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN title WHEN 1 THEN '' ELSE 'invalid JSON in p'||doc_id END AS said FROM papers", "papers")
def sidecar_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sidecars(V.papers(spark, sf_dir).withColumn("conversion", F.lit("done"))).select(of_path(), json_or_empty(F.col("text"), F.regexp_extract("path", r"(p\d+)/", 1)).alias("j"))
    return rows.select("doc_id", F.coalesce(F.get_json_object("j", "$.title"), F.get_json_object("j", "$.error"), F.lit("")).alias("said"))


@query(
    """SELECT code, count(*) AS n FROM (SELECT 'invalid-paper-yaml' AS code FROM papers WHERE doc_id % 17 = 0 UNION ALL SELECT 'invalid-conversion-json' FROM papers WHERE conversion IS NOT NULL AND doc_id % 3 = 2
  UNION ALL SELECT CASE WHEN doc_id % 4 = 0 THEN 'missing-local-executable' ELSE 'invalid-local-executable' END FROM papers WHERE doc_id % 2 = 0 AND (doc_id % 4 = 0 OR doc_id % 6 = 0) UNION ALL SELECT 'missing-library-config') GROUP BY code""",
    "papers",
)
def doctor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    facts = papers.select(F.lit("convert-pdf").alias("executable"), (doc() % 2 == 0).alias("wanted"), (doc() % 4 != 0).alias("exists"), F.when(doc() % 6 == 0, "exit code 1").alias("error"))
    found = D.audit(D.invalid_records(papers.withColumn("_corrupt", doc() % 17 == 0)), D.invalid_conversions(_sidecars(papers)), D.local_converter_issues(facts), D.missing_config(spark, "library", there=False))
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR (doc_id % 3 = 1 AND doc_id % 7 = 0)")
def invalid_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(doc() % 3 == 0, F.lit(" \t")).when((doc() % 3 == 1) & (doc() % 7 == 0), F.lit(None)).otherwise(F.col("source"))
    rows = docs_of(spark, sf_dir).select(F.concat(F.lit("inbox/p"), doc()).alias("bundle_path"), F.array(F.struct(F.lit("Li").alias("name"), F.lit("author").alias("role")), F.struct(name.alias("name"), F.lit("editor").alias("role"))).alias("creators"))
    return D.invalid_creators(rows).select(of_path())


@query("SELECT doc_id, CAST(strpos(text, 'the') AS BIGINT) % 7 + 1 AS number FROM documents WHERE doc_id % 5 = 0")
def corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of whole texts as JSON lines, of which some broke off."""
    whole, broken = F.to_json(F.struct("text")), F.instr("text", "the") % 7 + 1
    line = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.struct(i.alias("number"), F.when((doc() % 5 == 0) & (i == broken), F.rtrim(whole, F.lit("}"))).when(i == 3, " ").otherwise(whole).alias("line")))).alias("l")
    rows = docs_of(spark, sf_dir).select("doc_id", line).select("doc_id", "l.*")
    rows = rows.where((F.col("line") != " ") | (F.col("number") != 3))
    bad = rows.where(F.col("line").rlike(r"\S") & F.try_parse_json("line").isNull())
    return bad.join(D.corrupt_lines(rows, "jobs").select(F.regexp_extract("path", r":(\d+)", 1).cast("int").alias("number")).distinct(), "number").select("doc_id", "number")


ORACLES["corrupt_lines"] = "SELECT doc_id, CAST(strpos(text, 'the') % 7 + 1 AS BIGINT) AS number FROM documents WHERE doc_id % 5 = 0"


@query(
    """SELECT c_custkey AS library, p AS path, CASE WHEN p = 'naming.template' THEN CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE 'default' END WHEN p = 'ai.model' THEN c_name WHEN p = 'output' THEN 'text' WHEN p = 'output.json' THEN 'false' WHEN p = 'naming.sanitize.max' THEN '180' END AS value FROM customer,
  (SELECT unnest(['naming.template', 'naming.sanitize.max', 'output.json', 'output', 'ai.model']) AS p) WHERE NOT (p = 'output.json' AND c_custkey % 3 = 0) AND NOT (p = 'output' AND c_custkey % 3 <> 0) AND NOT (p = 'ai.model' AND c_custkey % 5 <> 0)"""
)
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "library")
    leaf = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    base = c.select("library", F.explode(F.array(leaf("naming.template", F.lit("default")), leaf("naming.sanitize.max", F.lit("180")), leaf("output.json", F.lit("false")))).alias("s")).union(c.where("library % 5 = 0").select("library", leaf("ai", F.lit("none")))).select("library", "s.*")
    k = F.col("library")
    own = F.filter(F.array(F.when(k % 2 == 0, leaf("naming.template", F.lit("own"))), F.when(k % 3 == 0, leaf("output", F.lit("text"))), F.when(k % 5 == 0, leaf("ai.model", F.col("c_name")))), lambda x: x.isNotNull())
    return G.merged_settings(base, c.select("library", F.explode(own).alias("s")).select("library", "s.*"))


@query("SELECT doc_id FROM papers WHERE collection IN ('src1', 'src4') OR (collection = 'src2' AND doc_id % 2 = 0)", "papers")
def collection_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    return papers.where(L.matches_collection({"src1", "src4"}) | L.matches_collection("src2") & (doc() % 2 == 0) & L.matches_collection(None)).select("doc_id")


@query("SELECT id, name, collection, bundle_path, conversion, metadata_status, title, doc_id FROM papers WHERE contains(lower(bundle_path), 'p7') AND bundle_path = (SELECT min(bundle_path) FROM papers WHERE contains(lower(bundle_path), 'p7') OR contains(lower(name), 'zzzz'))", "papers")
def paper_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir).where(F.lower("bundle_path").contains("p7"))
    first = papers.agg(F.min("bundle_path").alias("bundle_path"))
    return L.detail_rows(papers.join(first, "bundle_path")).select("id", "name", "collection", "bundle_path", "conversion", "metadata_status", "title", "doc_id")


# Metadata.


@query(
    r"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unknown-'||doc_id ELSE 'T'||trim(regexp_replace(text, '\s+', ' ', 'g')) END AS title, CASE WHEN doc_id % 4 <> 3 THEN 'Ab'||doc_id WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'Di Fu|Ed Go' ELSE '' END AS creators, CASE WHEN doc_id % 4 <> 3 THEN CAST(1950 + doc_id % 70 AS BIGINT) END AS year,
  CASE WHEN doc_id % 4 = 3 THEN 'filename-stem' ELSE 'filename' END AS title_source, CASE WHEN doc_id % 4 <> 3 THEN 'filename' WHEN doc_id % 2 = 1 AND doc_id % 3 = 0 THEN 'pdf-metadata' END AS creators_source, 'detected' AS language_source, 'en' AS language FROM documents"""
)
def fast_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names say, whole texts as their titles, and PDFs of some of them."""
    stem = F.when(doc() % 4 != 3, F.concat(F.lit("Ab"), doc(), F.lit(" et al. - "), 1950 + doc() % 70, F.lit(" - T"), T.collapse(F.col("text")))).otherwise(F.concat(F.lit("unknown-"), doc()))
    pdf = M.pdf_details(F.lit("Own title"), F.when((doc() % 2 == 1) & (doc() % 3 == 0), "Di Fu and Ed Go"))
    rows = docs_of(spark, sf_dir).select("doc_id", M.fast_metadata(M.file_name_details(stem), pdf).alias("m"))
    names = F.array_join(F.transform("m.metadata.creators", lambda x: x["name"]), "|")
    return rows.select("doc_id", "m.metadata.title", names.alias("creators"), "m.metadata.year", F.col("m.sources")["title"].alias("title_source"), F.col("m.sources")["creators"].alias("creators_source"), F.col("m.sources")["language"].alias("language_source"), "m.metadata.language")


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted documents: a title, a line of authors in several forms, a year and identifiers, then the whole text as one line."""
    title = F.when(doc() % 7 == 3, "aB title").otherwise(F.concat(F.lit("Study "), doc()))
    who = F.when(doc() % 4 == 0, "Authors: Ann Lee, Bo Li\n\n").when(doc() % 4 == 1, "Cy Do, Di Fu\n\n").otherwise("")
    year, ids = F.when(doc() % 3 == 0, "Year: 2001\n").otherwise(""), F.when(doc() % 5 == 0, F.concat(F.lit("received, doi 10.5555/x"), doc(), F.lit(".\n"))).otherwise("")
    body = F.concat(F.lit("\nreceived "), F.translate("text", "\n", " "))
    return docs_of(spark, sf_dir).select("doc_id", F.concat(F.lit("# "), title, F.lit("\n\n"), who, year, ids, body).alias("markdown"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 7 <> 3 THEN 'Study '||doc_id END AS title, CASE doc_id % 4 WHEN 0 THEN 'Ann Lee|Bo Li' WHEN 1 THEN 'Cy Do|Di Fu' END AS creators, CASE WHEN doc_id % 3 = 0 THEN CAST(2001 AS BIGINT) END AS year, CASE WHEN doc_id % 5 = 0 THEN '10.5555/x'||doc_id END AS doi,
  CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' END AS creators_confidence, 'en' AS language FROM documents"""
)
def converted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_title_page_authors(_converted(spark, sf_dir))
    fields = M.leading_fields(F.transform(T.lines(F.col("markdown")), lambda x: T.strip(T.without_controls(x))))
    rows = rows.select("doc_id", M.extracted(F.col("markdown"), fields, F.col("authors_line"), F.lit("")).alias("m"))
    return rows.select("doc_id", "m.metadata.title", F.array_join(F.transform("m.metadata.creators", lambda x: x["name"]), "|").alias("creators"), "m.metadata.year", "m.metadata.doi", F.col("m.confidence")["creators"].alias("creators_confidence"), "m.metadata.language")


@query("SELECT doc_id, text AS title, CAST(0 AS BIGINT) AS creators, 'en' AS language, true AS no_year FROM documents")
def empty_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", M.empty_metadata(F.col("text")).alias("m"))
    return rows.select("doc_id", "m.title", F.size("m.creators").alias("creators"), "m.language", F.col("m.year").isNull().alias("no_year"))


@query("SELECT doc_id, true AS same, doc_id % 2 = 0 AS equal FROM documents")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with whole texts, in two orders of keys and with white space, and with another value in half of them."""
    text = F.to_json(F.struct("text"))
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    one = F.concat(F.lit('{"b":1,"a":{"y":2,"x":3},'), inner, F.lit("}"))
    two = F.concat(F.lit("{ "), inner, F.lit(' , "a" : {"x":3, "y":2}, "b": 1 }'))
    other = F.when(doc() % 2 == 0, one).otherwise(F.concat(F.lit('{"b":2,"a":{"y":2,"x":3},'), inner, F.lit("}")))
    return docs_of(spark, sf_dir).select("doc_id", (T.json_hash(one) == T.json_hash(two)).alias("same"), (T.json_hash(one) == T.json_hash(other)).alias("equal"))


# Import and conversion.


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of pending papers, with titles of file names."""
    confidence = F.when(doc() % 2 == 0, "low").otherwise("high")
    return V.papers(spark, sf_dir).select(
        "doc_id", "id", F.concat(F.lit("n"), doc()).alias("name"), "bundle_path", M.empty_metadata(F.concat(F.lit("Ann Lee - Study "), doc())).alias("metadata"), F.create_map(F.lit("title"), F.lit("filename")).alias("metadata_sources"), F.create_map(F.lit("title"), confidence).alias("metadata_confidence"),
        (doc() % 6 == 0).alias("name_locked"), F.array().cast("array<string>").alias("previous_names"), F.lit("pending").alias("conversion"), F.lit("partial").alias("metadata_status"), F.lit("fast").alias("naming_status"),
    )


_DONE = "doc_id % 9 <> 0"
_OWN = "CASE WHEN doc_id % 7 = 3 THEN 'Ann Lee - Study '||doc_id ELSE 'Study '||doc_id END"
_WHO = "CASE doc_id % 4 WHEN 0 THEN 'Ann Lee|Bo Li' WHEN 1 THEN 'Cy Do|Di Fu' ELSE CASE WHEN doc_id % 7 = 3 THEN '' ELSE 'Ann Lee' END END"


@query(
    f"""SELECT doc_id, CASE WHEN {_DONE} THEN 'done' ELSE 'failed' END AS conversion, CASE WHEN {_DONE} AND (doc_id % 2 = 0 OR doc_id % 7 <> 3) THEN {_OWN} ELSE 'Ann Lee - Study '||doc_id END AS title, CASE WHEN {_DONE} THEN {_WHO} ELSE '' END AS creators,
  CASE WHEN {_DONE} THEN CASE WHEN doc_id % 7 = 3 THEN 'review' ELSE 'metadata' END ELSE 'fast' END AS naming, CASE WHEN {_DONE} THEN CASE WHEN doc_id % 7 = 3 THEN 'filename' ELSE 'converted' END ELSE 'filename' END AS title_source FROM documents"""
)
def finish_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results taken into records: titles by confidence, creators before titles, failures, names that need review."""
    results = _converted(spark, sf_dir).join(_records(spark, sf_dir).select("doc_id", "bundle_path"), "doc_id").select("bundle_path", (doc() % 9 != 0).alias("ok"), F.when(doc() % 9 != 0, F.col("markdown")).alias("markdown"))
    rows = C.finished(_records(spark, sf_dir), results)
    return rows.select("doc_id", "conversion", "metadata.title", F.array_join(F.transform("metadata.creators", lambda x: x["name"]), "|").alias("creators"), F.col("naming_status").alias("naming"), F.col("metadata_sources")["title"].alias("title_source"))


@query(
    """SELECT doc_id, root||'/'||CASE WHEN doc_id % 6 = 0 THEN 'p'||doc_id WHEN k = 1 THEN own ELSE own||'-'||k END AS bundle_path, doc_id % 6 <> 0 AS renamed FROM (SELECT *, row_number() OVER (PARTITION BY root, own ORDER BY bundle_path) AS k FROM
  (SELECT doc_id, bundle_path, regexp_replace(bundle_path, '/[^/]*$', '') AS root, CASE WHEN doc_id % 6 = 0 THEN 'p'||doc_id ELSE 'Li et al. - Study '||(doc_id % 10) END AS own FROM papers))""",
    "papers",
)
def rename_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that metadata give, of which many are the same in a folder; locked ones stay."""
    record = F.struct(F.concat(F.lit("Study "), doc() % 10).alias("title"), F.array(F.struct(F.lit("Li").alias("name"), F.lit("author").alias("role"))).alias("creators"), F.lit(None).cast("int").alias("year"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("doi"))
    rows = C.renamed(_records(spark, sf_dir).withColumn("metadata", record), F.lit("now"))
    return rows.select("doc_id", "bundle_path", F.col("old_path").isNotNull().alias("renamed"))


@query("SELECT path, CASE WHEN k = 1 AND NOT known THEN 'inbox/'||regexp_replace(path, '^.*/', '') END AS bundle_path FROM (SELECT bundle_path||'.pdf' AS p, bundle_path AS path, row_number() OVER (PARTITION BY id ORDER BY string_split(bundle_path, '/')) AS k, bool_or(doc_id % 50 = 0) OVER (PARTITION BY id) AS known FROM papers) WHERE k = 1 AND NOT known", "papers")
def import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir)
    none = F.lit(None).cast("string")
    files = papers.select("id", F.concat("bundle_path", F.lit(".pdf")).alias("path"), none.alias("pdf_title"), none.alias("pdf_author"))
    rows = C.imported(files, papers.where("doc_id % 50 = 0").select("id", F.lit("collections/other/x").alias("bundle_path")), F.lit("now"))
    return rows.select(F.regexp_replace("source.imported_from", r"\.pdf\z", "").alias("path"), "bundle_path")


ORACLES["import_records"] = ORACLES["import_records"].replace("(PARTITION BY id ORDER BY string_split(bundle_path, '/'))", "(PARTITION BY id ORDER BY string_split(bundle_path||'.pdf', '/'))")


@query("SELECT paper_id, count(*) AS parts, max(10 * part) AS page_count, bool_and(ok) AS ok, string_agg(coalesce(error, '')||'@'||(10 * part - 9), '|' ORDER BY part) AS each FROM parts GROUP BY paper_id", "parts")
def split_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    parts = V.parts(spark, sf_dir).withColumns({"page_start": 10 * F.col("part") - 9, "page_end": 10 * F.col("part"), "data_id": none, "batch_id": none, "remote_state": none, "zip_url": none})
    p = F.col("raw.split_parts")
    rows = I.split_provenance(parts, 10)
    each = F.array_join(F.transform(p, lambda x: F.concat(F.coalesce(x["error"], F.lit("")), F.lit("@"), x["page_start"])), "|")
    return rows.select("paper_id", F.size(p).alias("parts"), F.col("raw.page_count").cast("long").alias("page_count"), F.forall(p, lambda x: x["ok"]).alias("ok"), each.alias("each"))


@query("SELECT bundle_path, CAST(attempt AS BIGINT) AS attempt, converter FROM conversions WHERE state <> 'running' AND hash(bundle_path) IS NOT NULL AND CAST(regexp_extract(bundle_path, 'o(\\d+)$', 1) AS BIGINT) % 4 <> 1".replace("\\\\", "\\"), "conversions")
def batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = V.conversions(spark, sf_dir)
    key = F.regexp_extract("bundle_path", r"o(\d+)\z", 1).cast("long")
    results = items.where("state <> 'running'").where(key % 4 != 1).select("bundle_path", F.lit(True).alias("ok")).union(items.limit(3).select(F.concat("bundle_path", F.lit("?")), F.lit(True)))
    return I.batch_rows(results, items.select("bundle_path", "attempt", "converter")).select("bundle_path", F.col("item_attempt").alias("attempt"), F.col("item_converter").alias("converter"))


@query(
    """SELECT bundle_path, CASE WHEN state = 'done' THEN 'done' ELSE 'failed' END AS state, CASE WHEN state <> 'done' THEN 'error of '||bundle_path END AS error, batch_id, CASE WHEN state = 'done' THEN 'raw/converter' END AS raw_output_dir, CAST(attempt + 1 AS BIGINT) AS attempt FROM conversions WHERE state <> 'running'
  UNION ALL SELECT bundle_path, 'running', NULL, 'batch-x', NULL, CAST(attempt AS BIGINT) FROM conversions WHERE state = 'running'""",
    "conversions",
)
def conversion_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of finished conversions in place of running ones, and running ones of a batch."""
    own = V.conversions(spark, sf_dir)
    running = K.running_rows(own, F.lit("batch-x"))
    results = own.where("state <> 'running'").withColumns({"ok": F.col("state") == "done", "error": F.concat(F.lit("error of "), "bundle_path"), "attempt": F.col("attempt") + 1})
    return K.upserted(running, K.conversion_rows(results, F.lit("now")), "bundle_path").select("bundle_path", "state", "error", "batch_id", "raw_output_dir", "attempt")


@query("SELECT count(*) AS n, sum(CASE WHEN chunk = 0 THEN 1 ELSE 0 END)::BIGINT AS in_first, max(chunk) AS last FROM (SELECT CAST(floor((row_number() OVER (ORDER BY string_split(bundle_path, '/')) - 1) / 20) AS BIGINT) AS chunk FROM papers)", "papers")
def chunks_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.chunks(V.papers(spark, sf_dir), 20, F.split("bundle_path", "/"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("chunk") == 0).alias("in_first"), F.max("chunk").alias("last"))


# Answers of providers.


@query("SELECT paper_id, block_id FROM sblocks UNION SELECT paper_id, 'b'||(pos + 1) FROM (SELECT paper_id, ord AS pos FROM sblocks WHERE ord % 2 = 0)", "sblocks")
def known_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = V.summary_blocks(spark, sf_dir)
    source = b.where("order % 2 = 0").select("paper_id", F.concat(F.lit("b"), F.col("order") + 1).alias("block_id"))
    return S.known_block_ids(b, source.union(b.select("paper_id", F.lit(""))))


@query("SELECT paper_id, count(*) AS n, min(warning) AS first FROM (SELECT n.paper_id, 'Graph node skipped: '||coalesce(n.id, '') AS warning FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM vnodes v WHERE v.paper_id = n.paper_id AND v.pos = n.pos)) GROUP BY paper_id", "nodes", "vnodes")
def graph_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.checked_nodes(V.graph_nodes(spark, sf_dir), V.known_blocks(spark, sf_dir)).where("warning is not null")
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.min("warning").alias("first"))


@query(
    """SELECT paper_id, count(*) AS n, count(DISTINCT warning) AS different FROM (SELECT e.paper_id, 'Graph edge skipped: '||source||'->'||target AS warning FROM edges e WHERE NOT (type <> 'cites' AND CAST(substring(source_block_ids[1], 2) AS INTEGER) < 40
  AND EXISTS (SELECT 1 FROM vnodes v WHERE v.paper_id = e.paper_id AND v.id = e.source) AND EXISTS (SELECT 1 FROM vnodes v WHERE v.paper_id = e.paper_id AND v.id = e.target))) GROUP BY paper_id""",
    "edges", "vnodes",
)
def edge_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = V.known_blocks(spark, sf_dir)
    rows = S.checked_edges(V.graph_edges(spark, sf_dir), S.valid_nodes(V.graph_nodes(spark, sf_dir), known), known).where("warning is not null")
    return rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_distinct("warning").alias("different"))


@query("SELECT paper_id, 'Unknown section skipped: x'||section_id AS warning FROM ssections WHERE pos % 4 = 0", "ssections")
def section_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _sections(spark, sf_dir)
    response = inputs.select("paper_id", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("x"), "section_id")).otherwise(F.col("section_id")).alias("section_id"))
    return S.unknown_sections(inputs, response)


@query(
    """SELECT p.paper_id, CASE WHEN p.paper_id % 10 = 0 THEN 'missing-summary' WHEN p.paper_id % 10 = 1 THEN 'invalid-summary' WHEN p.paper_id % 10 = 2 THEN 'invalid-source-map' WHEN nodes_bad OR coalesce(edges_bad, false) OR p.paper_id % 7 = 0 THEN 'missing-traceability' ELSE 'ok' END AS verdict
  FROM (SELECT paper_id, bool_or(len(list_filter(coalesce(source_block_ids, []), lambda x: CAST(substring(x, 2) AS INTEGER) >= 40)) > 0) AS nodes_bad FROM nodes GROUP BY paper_id) p LEFT JOIN (SELECT paper_id, bool_or(CAST(substring(source_block_ids[1], 2) AS INTEGER) >= 44) AS edges_bad FROM edges WHERE type = 'uses' AND CAST(substring(source_block_ids[1], 2) AS INTEGER) NOT BETWEEN 40 AND 43 GROUP BY paper_id) e USING (paper_id)""",
    "nodes", "edges",
)
def traceability_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons: files that are missing or broken, and sections, nodes and edges that name unknown blocks."""
    nodes, known = V.graph_nodes(spark, sf_dir), V.known_blocks(spark, sf_dir)
    k = F.col("paper_id") % 10
    papers = nodes.select("paper_id").distinct().withColumns({"has_summary": k != 0, "summary_ok": k != 1, "source_map_ok": k != 2})
    sections = papers.select("paper_id", F.lit("s1").alias("section_id"), F.when(F.col("paper_id") % 7 == 0, F.array(F.lit("b1"), F.lit("gone"))).otherwise(F.array(F.lit("b1"))).alias("block_ids"))
    edges = V.graph_edges(spark, sf_dir).where("type = 'uses'").where("cast(substring(source_block_ids[0], 2) as int) not between 40 and 43").withColumn("pos", F.monotonically_increasing_id())
    return S.traceability(papers, known, sections, nodes, edges)


def _themes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Themes of collections that name papers and blocks of which some are unknown; the papers; the blocks."""
    own = _hashes(spark, sf_dir).select("collection_key", "paper_id")
    other = F.when(F.col("paper_id") % 9 == 0, F.array(F.lit("gone"))).otherwise(F.array().cast("array<string>"))
    themes = own.select("collection_key", F.col("paper_id").alias("pos"), F.concat(F.lit("theme "), "paper_id").alias("name"), F.lit("s").alias("summary"), F.concat(F.array(F.col("paper_id").cast("string")), other).alias("paper_ids"), F.array(F.concat(F.lit("b"), F.col("paper_id") % 6)).alias("source_block_ids"))
    return themes, own.select("collection_key", F.col("paper_id").cast("string").alias("id")), own.select("collection_key").distinct().select("collection_key", F.explode(F.array(*(F.lit(f"b{i}") for i in range(4)))).alias("id"))


@query(f"SELECT {_KEY} AS collection_key, doc_id AS pos, CASE WHEN doc_id % 9 = 0 THEN 'Skipped collection theme with unknown paper IDs: theme '||doc_id WHEN doc_id % 6 >= 4 THEN 'Skipped collection theme with unknown block IDs: theme '||doc_id END AS warning FROM papers", "papers")
def theme_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.checked_themes(*_themes(spark, sf_dir)).select("collection_key", "pos", "warning")


@query(f"SELECT {_KEY} AS collection_key, doc_id AS pos, CASE WHEN doc_id % 8 = 0 THEN 'Skipped collection relation with unknown paper IDs' WHEN doc_id % 6 >= 4 OR doc_id % 5 = 4 THEN 'Skipped collection relation with unknown block IDs' END AS warning FROM papers", "papers")
def relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes, papers, blocks = _themes(spark, sf_dir)
    p = F.col("pos")
    relations = themes.select("collection_key", "pos", F.lit("extends").alias("type"), p.cast("string").alias("source_paper_id"), F.when(p % 8 != 0, p.cast("string")).alias("target_paper_id"), F.lit("s").alias("summary"), "source_block_ids", F.array(F.concat(F.lit("b"), p % 5)).alias("target_block_ids"))
    return Y.checked_relations(relations, papers, blocks).select("collection_key", "pos", "warning")


@query("SELECT DISTINCT CAST(paper_id % 5 AS VARCHAR) AS collection_key, block_id AS id FROM (SELECT paper_id, block_id, row_number() OVER (PARTITION BY paper_id ORDER BY CASE importance WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, ord) AS rank FROM sblocks) WHERE rank <= 5", "sblocks")
def pooled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The important blocks of any paper of a collection."""
    top = Y.important_blocks(V.summary_blocks(spark, sf_dir)).groupBy("paper_id").agg(F.collect_list("block_id").alias("important_block_ids"))
    return Y.pooled_ids(top.withColumn("collection_key", (F.col("paper_id") % 5).cast("string")), "important_block_ids")


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _hashes(spark, sf_dir).groupBy("collection_key").agg(F.count("*").alias("papers"))
    return own.select("collection_key", F.when(F.length("collection_key") == 4, "own text").alias("overview"), F.array(*(F.lit(f"t{i}") for i in range(7))).alias("themes"), F.array(F.lit("r")).alias("representatives"), "papers")


def _answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a provider says of collections: under paths in several forms, some twice, some of no collection."""
    c = _collections(spark, sf_dir).select("collection_key")
    n = F.length("collection_key")
    row = lambda path, summary, pos: c.select(pos.alias("pos"), path.alias("collection_path"), summary.alias("summary"), F.when(n == 5, F.array(F.lit("said"), F.lit(""))).alias("main_themes"), F.array(F.lit("gone"), F.lit("1"), F.lit("2")).alias("representative_paper_ids"))
    place = F.xxhash64("collection_key")
    first = row(F.concat(F.lit("collections/"), "collection_key", F.lit("/_memory/collection-memory.json")), F.concat(F.lit("first "), "collection_key"), F.struct(F.lit(0).alias("a"), place.alias("b")))
    second = row(F.concat(F.lit("/"), "collection_key", F.lit("/")), F.when(n == 5, "").otherwise(F.concat(F.lit("second "), "collection_key")), F.struct(F.lit(1).alias("a"), place.alias("b")))
    unknown = row(F.concat("collection_key", F.lit("x")), F.lit("nothing"), F.struct(F.lit(2).alias("a"), place.alias("b")))
    return first.unionByName(second).unionByName(unknown)


@query(f"SELECT k||'x' AS collection_key, 'Skipped unknown collection in library response: '||k||'x' AS warning FROM (SELECT DISTINCT {_KEY} AS k FROM papers) WHERE k||'x' NOT IN (SELECT {_KEY} FROM papers)", "papers")
def collection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    return Y.checked_collections(_answer(spark, sf_dir), _collections(spark, sf_dir), known).where("warning is not null").select("collection_key", "warning")


@query(f"SELECT k AS collection_key, CASE WHEN length(k) = 5 THEN '' ELSE 'second '||k END AS summary, CASE WHEN length(k) = 5 THEN 'said' ELSE 't0|t1|t2|t3|t4' END AS main_themes, '1|2' AS representative_paper_ids, n AS paper_count FROM (SELECT {_KEY} AS k, count(*) AS n FROM papers GROUP BY 1)", "papers")
def library_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two answers for a collection the later one counts, and what it leaves empty is the collection's own."""
    known = docs_of(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"))
    own = _collections(spark, sf_dir)
    return Y.library_collections(own, Y.checked_collections(_answer(spark, sf_dir), own, known)).select("collection_key", "summary", joined("main_themes"), joined("representative_paper_ids"), "paper_count")


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'Skipped invalid global theme: '||c_name END AS warning FROM customer")
def global_theme_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    themes = V.table(spark, sf_dir, "customer").select(k.alias("pos"), F.col("c_name").alias("name"), F.lit("s").alias("summary"), F.array(F.lit("collections/a/"), F.when(k % 3 == 0, "gone").otherwise("/b/x.md")).alias("collection_paths"), F.when(k % 4 == 0, F.array(F.lit("p9"))).when(k % 5 == 0, F.array(F.lit("p1"))).alias("paper_ids"))
    memories = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("collection_key"))
    return Y.checked_global_themes(themes, memories, spark.range(2).select(F.concat(F.lit("p"), "id").alias("id"))).select("pos", "warning")


@query("SELECT c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'Skipped invalid cross-collection relation' END AS warning FROM customer")
def cross_relation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = V.table(spark, sf_dir, "customer").select(k.alias("pos"), F.lit("extends").alias("type"), F.lit("collections/a").alias("source_collection_path"), F.when(k % 3 != 0, "b/_memory/x.json").alias("target_collection_path"), F.lit("s").alias("summary"))
    memories = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("collection_key"))
    return Y.checked_cross_relations(rows, memories).select("pos", "warning")


@query(f"SELECT k AS collection_key, 'a/'||k AS path FROM (SELECT DISTINCT {_KEY} AS k FROM papers) WHERE k NOT LIKE '%3'", "papers")
def other_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _collections(spark, sf_dir).select("collection_key")
    stored = lambda folder, form: keys.select(F.concat(F.lit(folder), "collection_key").alias("path"), form.alias("collection_path"))
    both = stored("b/", F.col("collection_key")).union(stored("a/", F.concat(F.lit("collections/"), "collection_key", F.lit("/")))).union(keys.limit(2).select(F.lit("a/none"), F.lit(" ")))
    return Y.other_memories(both, keys.where("collection_key like '%3'")).select("collection_key", "path")


@query("SELECT 'paper' AS scope, CAST(c_custkey AS VARCHAR) AS key, true AS stale FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'library', 'library', c_custkey % 3 = 0 AND c_custkey % 2 = 0 FROM customer")
def state_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State files: whole ones, such with sections of another kind, and broken ones."""
    k = F.col("c_custkey")
    good = F.concat(F.lit('{"papers":{"'), k, F.lit('":{"stale":true,"reason":"r"}},"collections":[],"library":'), F.when(k % 2 == 0, '{"stale":true}').otherwise("7"), F.lit("}"))
    text = F.when(k % 3 == 0, good).when(k % 3 == 1, "{bad").otherwise('{"papers":"x","library":null}')
    return Y.repaired_state(V.table(spark, sf_dir, "customer").select(text.alias("text"))).select("scope", "key", "stale")


# Requests and look-ups.


@query("SELECT paper_id, count(*) AS requests, CAST(sum(n) AS BIGINT) AS blocks FROM (SELECT paper_id, batch, count(*) AS n FROM walk GROUP BY paper_id, batch) GROUP BY paper_id", "mapped")
def block_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.block_requests(B.source_map(V.markdown(spark, sf_dir)))
    n = F.size(F.from_json(F.get_json_object("messages", "$.blocks"), "array<struct<block_id:string>>"))
    return rows.groupBy("paper_id").agg(F.count("*").alias("requests"), F.sum(n).alias("blocks"))


_WALK = ORACLES["batch_pack"].rpartition("\n")[0]
ORACLES["block_requests"] = _WALK + "\nSELECT paper_id, count(*) AS requests, CAST(sum(n) AS BIGINT) AS blocks FROM (SELECT paper_id, batch, count(*) AS n FROM walk GROUP BY paper_id, batch) GROUP BY paper_id"


@query("SELECT doc_id, text AS title, doc_id AS year, 'Document '||doc_id AS first_heading FROM documents")
def paper_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = docs_of(spark, sf_dir).select(doc().alias("paper_id"), F.col("text").alias("title"), doc().alias("year"))
    rows = X.brief(papers, B.split_blocks(V.markdown(spark, sf_dir)))
    return rows.select(F.col("paper_id").alias("doc_id"), "brief.title", "brief.year", F.col("brief.headings")[0].alias("first_heading"))


@query("SELECT paper_id, CAST(length(string_agg(text, chr(10)||chr(10) ORDER BY ord)) > 0 AS BOOLEAN) AS has_head, 'p'||paper_id AS bundle_name FROM blocks WHERE ord < 40 GROUP BY paper_id", "blocks")
def metadata_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = V.papers(spark, sf_dir).select(doc().alias("paper_id"), "title", "bundle_path")
    found = X.metadata_requests(X.evidence(papers, B.markdown_head(B.split_blocks(V.markdown(spark, sf_dir)))))
    at = lambda path: F.get_json_object("messages", path)
    return found.select("paper_id", (F.length(at("$.evidence.markdown_head")) > 0).alias("has_head"), at("$.evidence.bundle_name").alias("bundle_name"))


@query("SELECT paper_id, count(*) AS blocks FROM found WHERE policy = 'auto_repair' GROUP BY paper_id", "found")
def markdown_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.markdown_requests(Q.classified(B.split_blocks(V.markdown(spark, sf_dir))))
    return rows.select("paper_id", F.size(F.from_json(F.get_json_object("messages", "$.blocks"), "array<struct<block_id:string>>")).alias("blocks"))


@query("SELECT paper_id, section_id, array_to_string(block_ids, '|') AS blocks FROM ssections", "ssections")
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.section_index(_sections(spark, sf_dir))
    return rows.select("paper_id", F.explode("blocks").alias("section_id", "b")).select("paper_id", "section_id", F.array_join("b", "|").alias("blocks"))


@query(f"SELECT {_KEY} AS collection_key, count(*) AS paper_count, CASE WHEN {_KEY} = '__root__' THEN '_memory/collections/__root__' ELSE 'collections/'||{_KEY}||'/_memory' END||'/collection-memory.json' AS memory_path FROM papers GROUP BY {_KEY}", "papers")
def collection_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collections(spark, sf_dir).select("collection_key", F.col("papers").alias("paper_count"), F.col("representatives").alias("representative_paper_ids"))
    return K.collection_index(rows).drop("representative_paper_ids")


@query(f"SELECT doc_id, bundle_path||'/extracts/summary/summary.json' AS summary, bundle_path||'/raw/converter' AS raw, CASE WHEN {_KEY} = '__root__' THEN '_memory/collections/__root__' ELSE 'collections/'||{_KEY}||'/_memory' END||'/paper-index.json' AS paper_index, CASE WHEN doc_id % 5 = 4 THEN 'p'||doc_id ELSE bundle_path END AS relative FROM papers", "papers")
def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = L.collection_key(F.col("collection"), F.col("bundle_path"))
    rows = V.papers(spark, sf_dir).select("doc_id", "bundle_path", K.output_paths(F.col("bundle_path"), key).alias("o"))
    return rows.select("doc_id", "o.summary", "o.raw", "o.paper_index", K.relative_to(F.col("bundle_path"), F.lit("inbox")).alias("relative"))


@query(
    """SELECT paper_id, '# AI Summary'||chr(10)||chr(10)||string_agg('## '||section_id||chr(10)||chr(10)||CASE WHEN trim(summary) <> '' THEN '- Section summary: '||rtrim(summary)||chr(10) ELSE '' END||'- Source blocks: '||array_to_string(block_ids, ', '), chr(10)||chr(10) ORDER BY pos)||chr(10) AS markdown FROM ssections GROUP BY paper_id""",
    "ssections",
)
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = V.graph_nodes(spark, sf_dir).limit(0)
    empty = F.lit("")
    edges = none.select("paper_id", "pos", empty.alias("source"), empty.alias("target"), "type", "source_block_ids")
    sections = _sections(spark, sf_dir).withColumns({"heading": F.col("section_id"), "key_points": F.array().cast("array<string>"), "summary": F.rtrim("summary")})
    return K.summary_report(sections, none, edges)


@query("SELECT paper_id, true AS dry_run, CAST(count(*) FILTER (ok) AS BIGINT) AS changes, count(*) FILTER (ok) > 0 AS changed FROM (SELECT doc_id AS paper_id, v = 'accepted' AS ok FROM documents LEFT JOIN (SELECT paper_id AS p, verdict AS v FROM gate) ON p = doc_id) GROUP BY paper_id")
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = B.split_blocks(V.markdown(spark, sf_dir)).limit(0)
    metadata = P.metadata_verdicts(_changes(spark, sf_dir), _current(spark, sf_dir))
    rows = K.repair_rows(metadata, P.patch_verdicts(_patches(blocks), blocks), docs_of(spark, sf_dir).select(doc().alias("paper_id")), F.lit("now"), dry_run=True)
    return rows.select("paper_id", "dry_run", F.size("changes").alias("changes"), F.col("metadata_changed").alias("changed"))


ORACLES["repair_report"] = f"WITH gate AS ({ORACLES['metadata_gate']})\n" + ORACLES["repair_report"]


@query("SELECT doc_id, text, doc_id % 2 = 0 AS even, CAST(NULL AS VARCHAR) AS none FROM documents")
def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as JSON lines and back; nulls are stated."""
    line = K.emitted(F.struct("doc_id", "text", (doc() % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none")))
    rows = docs_of(spark, sf_dir).select(line.alias("j")).where(F.col("j").endswith('"none":null}'))
    return rows.select(F.from_json("j", "doc_id long, text string, even boolean, none string").alias("r")).select("r.*")
