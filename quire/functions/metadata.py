"""Bibliographic expressions: file names, creators, titles, identifiers, confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Fixed values.
RANKS = {"low": 1, "medium": 2, "high": 3}
FILE_NAME = r"(?Ud)\A(.+?)\s+-\s+(\d{4})\s+-\s+(.+)\z"
DOI = r"(?i)\b(10\.\d{4,9}/[^\s<>'\"{}|\\^`\]]+)"
ARXIV = r"(?i)\barXiv\s*:\s*([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)"
DOI_CANDIDATE = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
ARXIV_CANDIDATE = r"(?i)\b\d{4}\.\d{4,5}(?:v\d+)?\b"
PMID_CANDIDATE = r"(?i)\bPMID[:\s]+(\d+)\b"
ISBN_CANDIDATE = r"\b(?:97[89][-\s]?)?\d[-\s]?\d{3}[-\s]?\d{5}[-\s]?\d\b"
JOURNALS = ("SCIENTIFIC REPORTS", "NATURE", "SCIENCE", "PHYSICAL REVIEW LETTERS", "PHYSICAL REVIEW A", "PHYSICAL REVIEW E", "NEW JOURNAL OF PHYSICS")
DASHES = "[‐-―−]"
_CREATORS = "array<struct<name:string,role:string>>"


def rank(confidence: Column) -> Column:
    return F.coalesce(*(F.when(confidence == k, v) for k, v in RANKS.items()), F.lit(0))


def _clean_name(c: Column) -> Column:
    return T.strip(F.regexp_replace(T.strip(T.without_controls(c)), r"(?iU)\s+et\s+al\.?\z", ""))


def creators(c: Column) -> Column:
    """Names out of one string, all as authors; a part that is left blank empties the list."""
    flat = F.regexp_replace(T.strip(c), r"(?U)\s+and\s+", ",")
    parts = F.filter(F.transform(F.split(flat, "[;,]"), T.strip), lambda x: x != "")
    named = F.transform(parts, lambda x: F.struct(_clean_name(x).alias("name"), F.lit("author").alias("role")))
    return T.let(_all_named, named.cast(_CREATORS))


def _all_named(items: Column) -> Column:
    return F.coalesce(F.when(F.forall(items, lambda x: x["name"] != ""), items), F.array().cast(_CREATORS))


def creators_of(items: Column) -> Column:
    """The same for a list of (name, role)."""
    named = F.transform(items, lambda x: F.struct(_clean_name(F.coalesce(x["name"], F.lit(""))).alias("name"), F.coalesce(T.blank_to_null(T.strip(F.coalesce(x["role"], F.lit("author")))), F.lit("author")).alias("role")))
    return T.let(_all_named, named.cast(_CREATORS))


def valid_creators(items: Column) -> Column:
    return items.isNotNull() & F.forall(items, lambda x: F.coalesce(T.strip(x["name"]) != "", F.lit(False)))


def _clean_stem(c: Column) -> Column:
    return T.strip(T.without_controls(c))


def from_file_name(stem: Column, clean: Callable[[Column], Column] = _clean_stem) -> Column:
    """(title, creator, year, language, title_source, title_confidence) of "creator - year - title", as ``clean`` leaves it."""

    def parts(s: Column) -> Column:
        found = s.rlike(FILE_NAME)
        who = F.get(creators(F.regexp_extract(s, FILE_NAME, 1)), F.lit(0))["name"]
        return T.let(fields, found, F.when(found, who), F.when(found, T.strip(F.regexp_extract(s, FILE_NAME, 3))).otherwise(s), F.when(found, F.regexp_extract(s, FILE_NAME, 2).cast("int")))

    def fields(found: Column, creator: Column, title: Column, year: Column) -> Column:
        return F.struct(
            title.alias("title"), creator.alias("creator"), year.alias("year"), T.language(F.concat_ws(" ", creator, title)).alias("language"),
            F.when(title != "", F.when(found, "filename").otherwise("filename-stem")).alias("title_source"), F.when(title != "", F.when(found, "medium").otherwise("low")).alias("title_confidence"),
        )

    return T.let(parts, clean(stem))


def display_name(creator: Column, year: Column, title: Column, language: Column) -> Column:
    """Creator (et al.) - year - title, of what there is."""
    who = T.strip(F.coalesce(creator, F.lit("")))
    head = F.when(who == "", "").when(T.strip(F.coalesce(language, F.lit(""))).isin("zh", "zh-CN"), F.concat(who, F.lit(" - "))).otherwise(F.concat(who, F.lit(" et al. - ")))
    when = F.coalesce(F.concat(year.cast("string"), F.lit(" - ")), F.lit(""))
    what = T.strip(F.coalesce(title, F.lit("")))
    what = F.when(F.length(what) > 100, F.regexp_replace(F.substring(what, 1, 100), r"(?U)\s+\z", "")).otherwise(what)
    return T.strip_chars(T.collapse(F.concat(head, when, what)), " -")


def bad_converted_title(existing: Column, converted: Column) -> Column:
    def bad(old: Column, given: Column, t: Column) -> Column:
        letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
        shouted = (F.coalesce(old, F.lit("")) != "") & (F.upper(t) == t) & (letters >= 20)
        return F.coalesce((given != "") & (t.rlike(r"[\\/|]\z") | t.contains("�") | shouted | t.rlike("[a-z][A-Z]")), F.lit(False))

    return T.let(bad, existing, converted, T.strip(converted))


def is_journal_label(title: Column) -> Column:
    s = T.strip(title)
    return (s == "") | F.upper(T.collapse(s)).isin(*JOURNALS)


def creator_before_title(previous: Column, converted: Column) -> Column:
    """The creator that a file name's title has before the converted title."""
    same = lambda c: T.collapse(F.regexp_replace(c, DASHES, "-"))

    def prefixed(p: Column, c: Column) -> Column:
        before = T.strip(F.regexp_replace(T.strip(F.substring(p, F.lit(1), F.length(p) - F.length(c))), r"[-:：|丨]+\z", ""))
        return T.let(lambda x: F.when((p != "") & (c != "") & (p != c) & p.endswith(c) & (x != "") & (F.length(x) <= 80) & ~x.rlike(r"\d"), x), before)

    return T.let(prefixed, same(previous), same(converted))


def first_doi(t: Column) -> Column:
    return T.blank_to_null(F.regexp_replace(F.regexp_extract(t, DOI, 1), r"[.,;)]+\z", ""))


def first_arxiv(t: Column) -> Column:
    return T.blank_to_null(F.regexp_extract(t, ARXIV, 1))


def identifiers(t: Column) -> Column:
    """All candidates of each kind, sorted and distinct."""
    found = lambda pattern, group: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), group)))
    return F.struct(found(DOI_CANDIDATE, 0).alias("doi"), found(ARXIV_CANDIDATE, 0).alias("arxiv"), found(PMID_CANDIDATE, 1).alias("pmid"), found(ISBN_CANDIDATE, 0).alias("isbn"))


def leading_fields(lines: Column) -> Column:
    """(heading, authors_line, year) stated in the first lines of a document; lines are cleaned and stripped."""

    def fields(lines: Column, head: Column) -> Column:
        title = T.blank_to_null(T.strip(F.substring(F.get(F.filter(lines, lambda x: x.startswith("# ")), F.lit(0)), 3, 1 << 30)))
        authors = F.get(F.filter(head, lambda x: F.lower(x).startswith("authors:")), F.lit(0))
        year = F.get(F.filter(head, lambda x: F.lower(x).startswith("year:") & x.rlike(r"\d{4}")), F.lit(0))
        return F.struct(title.alias("heading"), T.strip(F.regexp_replace(authors, r"(?s)\A[^:]*:", "")).alias("authors_line"), F.regexp_extract(year, r"\d{4}", 0).try_cast("int").alias("year"))

    return T.let(fields, lines, F.slice(lines, 1, 80))


def _known(*pairs: tuple[str, Column, Column]) -> Column:
    """A map of labels of the fields (name, value, label) that have a value."""
    return F.map_from_entries(F.filter(F.array(*(F.when(value, F.struct(F.lit(name).alias("key"), label.alias("value"))) for name, value, label in pairs)), lambda x: x.isNotNull()))


def _record(title: Column, who: Column, year: Column, language: Column) -> Column:
    return F.struct(title.alias("title"), who.alias("creators"), year.cast("int").alias("year"), language.alias("language"), F.lit(None).cast("string").alias("doi"))


def empty_metadata(title: Column) -> Column:
    """(title, creators, year, language, doi) of a document of which only a title is known, which may be blank."""
    return _record(title, F.array().cast(_CREATORS), F.lit(None), T.language(title))


def _details(record: Column, sources: Column, confidence: Column) -> Column:
    return F.struct(record.alias("metadata"), sources.alias("sources"), confidence.alias("confidence"))


def file_name_details(stem: Column) -> Column:
    """(metadata, sources, confidence) out of a file's name."""

    def details(f: Column, who: Column) -> Column:
        has = (("title", f["title"] != ""), ("creators", F.size(who) > 0), ("year", f["year"].isNotNull()))
        labels = {"title": (f["title_source"], f["title_confidence"])}
        pick = lambda i, last: _known(*((k, v, labels[k][i] if k in labels else F.lit(("filename", "medium")[i])) for k, v in has), ("language", F.lit(True), F.lit(last)))
        return _details(_record(f["title"], who, f["year"], f["language"]), pick(0, "detected"), pick(1, "medium"))

    one = lambda f: F.when(f["creator"] != "", F.array(F.struct(f["creator"].alias("name"), F.lit("author").alias("role")))).otherwise(F.array()).cast(_CREATORS)
    return T.let(lambda f: T.let(details, f, one(f)), from_file_name(stem))


def pdf_details(title: Column, author: Column) -> Column:
    """The same out of a PDF's own document information."""
    clean = lambda c: T.strip(T.without_controls(F.coalesce(c, F.lit(""))))

    def details(t: Column, who: Column) -> Column:
        pick = lambda label, last: _known(("title", t != "", F.lit(label)), ("creators", F.size(who) > 0, F.lit(label)), ("language", F.lit(True), F.lit(last)))
        return _details(_record(t, who, F.lit(None), T.language(t)), pick("pdf-metadata", "detected"), pick("medium", "medium"))

    return T.let(details, clean(title), creators(clean(author)))


def fast_metadata(file: Column, pdf: Column) -> Column:
    """What a file's name says, its blanks filled by the PDF's own information; the language is that of the result."""

    def filled(f: Column, p: Column) -> Column:
        own_title, own_who = F.coalesce(f["metadata"]["title"], F.lit("")) != "", F.size(f["metadata"]["creators"]) > 0
        title = F.when(own_title, f["metadata"]["title"]).otherwise(p["metadata"]["title"])
        return T.let(joined, f, p, own_title, own_who, title, F.when(own_who, f["metadata"]["creators"]).otherwise(p["metadata"]["creators"]))

    def joined(f: Column, p: Column, own_title: Column, own_who: Column, title: Column, who: Column) -> Column:
        def labels(side: str) -> Column:
            kept = F.map_filter(p[side], lambda k, v: ((k == "title") & ~own_title) | ((k == "creators") & ~own_who))
            return T.let(lambda own, more: F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(more, k)), more), f[side], kept)

        language = T.language(F.concat_ws(" ", title, F.array_join(F.transform(who, lambda x: x["name"]), " ")))
        return _details(_record(title, who, f["metadata"]["year"], language), labels("sources"), labels("confidence"))

    return T.let(filled, file, pdf)


def extracted(markdown: Column, fields: Column, title_page: Column, existing_title: Column) -> Column:
    """(metadata, sources, confidence) of a converted document: ``fields`` are its leading fields, ``title_page`` the authors found under its title.

    A field that isn't found is null and has no labels; arXiv is one of them.
    """

    def lines(f: Column, page: Column, doi: Column, arxiv: Column, old: Column) -> Column:
        heading = f["heading"]
        title = F.when(~is_journal_label(F.coalesce(heading, F.lit(""))) & ~bad_converted_title(old, heading), heading)
        line = F.coalesce(f["authors_line"], page)
        return T.let(details, title, heading, line, F.coalesce(creators(line), F.array().cast(_CREATORS)), f["year"], f["authors_line"].isNotNull(), doi, arxiv)

    def details(title: Column, heading: Column, line: Column, who: Column, year: Column, stated: Column, doi: Column, arxiv: Column) -> Column:
        some = heading.isNotNull() | (F.size(who) > 0)
        language = F.when(some, T.language(F.concat_ws(" ", heading, line)))
        record = F.struct(title.alias("title"), F.when(F.size(who) > 0, who).alias("creators"), year.alias("year"), language.alias("language"), doi.alias("doi"), arxiv.alias("arxiv"))
        found = (("title", title.isNotNull()), ("year", year.isNotNull()), ("doi", doi.isNotNull()), ("arxiv", arxiv.isNotNull()))
        pick = lambda label, of_page, last: _known(*((k, v, F.lit(label)) for k, v in found), ("creators", F.size(who) > 0, F.when(stated, label).otherwise(of_page)), ("language", some, F.lit(last)))
        return _details(record, pick("converted", "converted-title-page", "detected"), pick("high", "medium", "medium"))

    return T.let(lines, fields, title_page, first_doi(markdown), first_arxiv(markdown), existing_title)
