"""The library views of ``views`` in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

from quire.operators.blocks import NON_MAIN_SECTIONS
from quire.plans.views import PREFIXES

_prefixes = ", ".join("'" + p.replace("\n", "'||chr(10)||'") + "'" for p in PREFIXES)
_non_main = "|".join(NON_MAIN_SECTIONS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def pick(values: tuple[str, ...], at: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[1 + ({at}) % {len(values)}]"


def _section(k: int) -> str:
    return f"last_value(CASE WHEN type = 'heading' AND level <= {k} THEN {{'lv': level, 'push': push, 'no': secno, 'h': heading}} END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord) AS h{k}"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "md": ((), f"SELECT doc_id AS paper_id, '# Document '||doc_id||chr(10)||chr(10)||array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: ([{_prefixes}])[1 + (doc_id + i - 1) % {len(PREFIXES)}] || x), chr(10)||chr(10)) AS markdown FROM documents"),
    "mdlines": (("md",), "SELECT paper_id, unnest(range(1, len(ls) + 1)) AS ln, unnest(ls) AS line FROM (SELECT paper_id, string_split(markdown, chr(10)) AS ls FROM md)"),
    "flagged": (("mdlines",), r"SELECT *, regexp_matches(line, '\S') AS solid, line LIKE '#%' AS hash, lag(regexp_matches(line, '\S')) OVER (PARTITION BY paper_id ORDER BY ln) AS prev FROM mdlines"),
    "numbered": (("flagged",), "SELECT paper_id, ln, line, solid, CAST(sum(CASE WHEN solid AND (NOT coalesce(prev, false) OR hash) THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ln) - 1 AS BIGINT) AS ord FROM flagged"),
    "grouped": (("numbered",), "SELECT paper_id, ord, min(ln) AS start_line, max(ln) AS end_line, string_agg(line, chr(10) ORDER BY ln) AS text FROM numbered WHERE solid GROUP BY paper_id, ord"),
    "typed": (
        ("grouped",),
        rf"""SELECT *, {strip('text')} AS s, CASE WHEN {strip('text')} LIKE '#%' THEN 'heading' WHEN {strip('text')} LIKE '![%' THEN 'image' WHEN {strip('text')} LIKE '$$%' OR {strip('text')} LIKE '%$$' THEN 'formula'
          WHEN lower(text) LIKE '%<table%' OR lower(text) LIKE '%</table>%' THEN 'table' WHEN len(list_filter(string_split({strip('text')}, chr(10)), lambda x: NOT ltrim(x) LIKE '|%')) = 0 THEN 'table'
          WHEN regexp_matches({strip('text')}, '^(?i:references|bibliography)$') THEN 'reference' ELSE 'paragraph' END AS kind, regexp_matches({strip('text')}, '^#+\s*(?i:references|bibliography)\b') AS refers FROM grouped""",
    ),
    "blocks": (("typed",), "SELECT paper_id, ord, printf('b%05d', ord) AS block_id, CASE WHEN coalesce(last_value(CASE WHEN kind = 'heading' THEN refers END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord), false) THEN 'reference' ELSE kind END AS type, start_line, end_line, text, s FROM typed"),
    "leveled": (("blocks",), f"SELECT *, length(text) - length(ltrim(text, '#')) AS level, {strip('ltrim(text, ' + chr(39) + '#' + chr(39) + ')')} AS heading, type = 'heading' AND length(text) - length(ltrim(text, '#')) > 1 AND {strip('ltrim(text, ' + chr(39) + '#' + chr(39) + ')')} <> '' AS push FROM blocks"),
    "counted": (("leveled",), "SELECT *, sum(CASE WHEN push THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY ord) AS secno FROM leveled"),
    "stacked": (("counted",), f"SELECT *, {_section(2)}, {_section(3)}, {_section(4)} FROM counted"),
    "placed": (
        ("stacked",),
        """SELECT paper_id, ord, printf('blk_%06d', ord) AS block_id, type, start_line, end_line, text, s,
          CASE WHEN h4.lv = 4 AND h4.push THEN printf('sec_%04d', CAST(h4.no AS BIGINT)) WHEN h3.lv = 3 AND h3.push THEN printf('sec_%04d', CAST(h3.no AS BIGINT)) WHEN h2.lv = 2 AND h2.push THEN printf('sec_%04d', CAST(h2.no AS BIGINT)) END AS section_id,
          list_filter([CASE WHEN h2.lv = 2 AND h2.push THEN h2.h END, CASE WHEN h3.lv = 3 AND h3.push THEN h3.h END, CASE WHEN h4.lv = 4 AND h4.push THEN h4.h END], lambda x: x IS NOT NULL) AS path FROM stacked""",
    ),
    "mapped": (
        ("placed",),
        rf"""SELECT *, CASE WHEN skip_reason IS NULL THEN 'summarize' WHEN skip_reason IN ('formula', 'table', 'image') THEN 'context_only' ELSE 'skip' END AS summary_policy FROM (SELECT *,
          CASE WHEN type = 'reference' THEN 'reference_section' WHEN len(list_filter(path, lambda h: regexp_matches(lower(h), '^({_non_main})'))) > 0 THEN 'non_main_section' WHEN type = 'heading' THEN 'heading' WHEN type IN ('formula', 'table', 'image') THEN type
          WHEN s = '' OR regexp_matches(s, '^\d+$') OR lower(s) LIKE 'page %' OR lower(s) LIKE 'copyright%' OR lower(s) LIKE 'open access%' OR (length(s) < 8 AND regexp_matches(s, '\pL')) THEN 'noise' END AS skip_reason FROM placed)""",
    ),
    "found": (
        ("blocks",),
        r"""SELECT *, CASE WHEN list_contains(reasons, 'broken_image') THEN 'structural_warning' WHEN type IN ('formula', 'table', 'reference') OR list_contains(reasons, 'math_heavy') THEN 'review_only' WHEN list_contains(reasons, 'common_ocr_word') AND length(text) > 320 THEN 'review_only' ELSE 'auto_repair' END AS policy
          FROM (SELECT paper_id, ord, block_id, type, text, list_filter([CASE WHEN regexp_matches(s, '^(?i:\d+|page\s+\d+)$') THEN 'page_number' END, CASE WHEN contains(s, chr(65533)) THEN 'replacement_character' END, CASE WHEN sl THEN 'spaced_letters' END, CASE WHEN sd THEN 'spaced_digits' END,
            CASE WHEN (sl OR sd) AND (type IN ('formula', 'table', 'reference') OR (regexp_matches(text, '[$\\_^]') AND (length(text) - length(translate(text, '$\_^{}', '')) >= 8 OR regexp_matches(text, '\$[^$]*([A-Za-z0-9]\s+){2,}[A-Za-z0-9][^$]*\$')))) THEN 'math_heavy' END,
            CASE WHEN type = 'paragraph' AND regexp_matches(s, '(^|[^\pL\pN_])(Te|Tere|fssion|diferent|scientifc|efciency|frst|simplifed)($|[^\pL\pN_])') THEN 'common_ocr_word' END,
            CASE WHEN type = 'paragraph' AND len(list_filter([4, 5, 6, 7, 8], lambda n: len(list_filter(range(1, len(ws) - 2 * n + 2), lambda i: list_slice(ws, i, i + n - 1) = list_slice(ws, i + n, i + 2 * n - 1))) > 0)) > 0 THEN 'repeated_phrase' END,
            CASE WHEN lower(s) IN ('article', 'open', 'open access', 'check for updates', 'research article', 'original article') THEN 'front_matter_noise' END, CASE WHEN type = 'image' AND regexp_matches(s, '\]\([^)]+\)') THEN 'broken_image' END,
            CASE WHEN type = 'paragraph' AND length(s) < 8 AND regexp_matches(s, '[A-Za-z]') THEN 'short_text_noise' END], lambda x: x IS NOT NULL) AS reasons
          FROM (SELECT *, regexp_matches(s, '(^|[^A-Za-z])([A-Za-z]\s+){3,}[A-Za-z]($|[^A-Za-z])') AS sl, regexp_matches(s, '(^|\D)(\d\s+){2,}\d($|\D)') AS sd, regexp_extract_all(lower(s), '[a-z][a-z-]*') AS ws FROM blocks)) WHERE len(reasons) > 0""",
    ),
    "papers": (
        (),
        """SELECT d.doc_id, 'sha256:'||sha256(text) AS id, 'Paper '||replace(text, chr(10), ' ') AS name, CASE WHEN d.doc_id % 5 <> 4 THEN source END AS collection, CASE WHEN d.doc_id % 5 = 4 THEN 'inbox/p'||d.doc_id ELSE 'collections/'||source||'/p'||d.doc_id END AS bundle_path,
          text AS title, CASE d.doc_id % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN NULL ELSE 'done' END AS conversion, CASE quality WHEN 1 THEN 'complete' WHEN 0 THEN 'partial' END AS metadata_status,
          d.doc_id % 5 AS n_previous_names, d.doc_id % 11 <> 0 AS has_markdown, d.doc_id % 13 <> 0 AS has_pdf FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    ),
    "jobs": (
        (),
        """SELECT event_id, CASE WHEN event_type = 'click' THEN 'conversion-started' WHEN event_type IN ('purchase', 'error') THEN 'conversion-finished' ELSE 'other' END AS event, CASE WHEN user_id % 17 <> 0 THEN 'paper-'||user_id END AS paper_id,
          CASE WHEN k % 5 <> 4 THEN k % 4 END AS attempt, ts AS at FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    ),
    "conversions": (
        (),
        """SELECT 'collections/c'||(o % 20)||'/o'||o AS bundle_path, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'failed' END AS state, CASE WHEN o % 3 = 0 THEN 'batch-api' ELSE 'local' END AS converter, CASE WHEN o % 4 <> 0 THEN 'batch-'||(o % 9) END AS batch_id,
          CASE WHEN o % 5 <> 0 THEN 'data-'||o END AS data_id, CASE WHEN o % 23 = 0 THEN 'not a time' WHEN o % 29 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS submitted_at, CAST(floor(o_totalprice - 7 * floor(o_totalprice / 7)) AS INTEGER) AS attempt FROM (SELECT *, o_orderkey AS o FROM orders)""",
    ),
    "parts": ((), "SELECT l_orderkey AS paper_id, l_linenumber AS part, min(l_returnflag) <> 'R' AS ok, CASE WHEN min(l_returnflag) = 'R' THEN 'failed part '||l_linenumber END AS error, 'text ![](images/a.png) of '||CAST(floor(min(l_quantity)) AS INTEGER) AS markdown FROM lineitem GROUP BY l_orderkey, l_linenumber"),
    "sblocks": (
        (),
        f"""SELECT paper_id, pos AS ord, printf('blk_%06d', pos) AS block_id, printf('sec_%04d', pos // 3) AS section_id, line AS summary_text, {pick(('background', 'method', 'result', 'limitation', 'other'), 'paper_id * 7 + pos')} AS role, {pick(('high', 'medium', 'low', 'other'), '(paper_id * 7 + pos) // 2')} AS importance, string_split(line, ' ') AS concepts
          FROM (SELECT doc_id AS paper_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
    ),
    "ssections": (("sblocks",), "SELECT paper_id, section_id, min(ord) AS pos, array_to_string(list(summary_text ORDER BY ord)[1:3], ' ') AS summary, arg_min(role, ord) AS role, list(block_id ORDER BY ord) AS block_ids FROM sblocks GROUP BY paper_id, section_id"),
    "nodes": ((), f"SELECT p_partkey % 200 AS paper_id, p_partkey AS pos, CASE WHEN p_partkey % 31 <> 0 THEN 'n'||p_partkey END AS id, {pick(('concept', 'method', 'dataset_or_sample', 'instrument', 'measurement', 'result', 'limitation', 'claim', 'theory'), 'p_partkey')} AS type, p_name AS label, CASE WHEN p_partkey % 10 <> 0 THEN list_transform(range(0, p_partkey % 3 + 1), lambda i: 'b'||(p_partkey % 40 + i)) END AS source_block_ids FROM part"),
    "edges": ((), f"SELECT l_partkey % 200 AS paper_id, 'n'||l_partkey AS source, 'n'||(l_partkey % 200 + 200 * (l_suppkey % 10)) AS target, {pick(('uses', 'measures', 'produces', 'supports', 'compares_with', 'limits', 'depends_on', 'explains', 'cites'), 'l_orderkey + l_linenumber')} AS type, ['b'||((l_orderkey + l_linenumber) % 45)] AS source_block_ids FROM lineitem"),
    "vnodes": (("nodes",), "SELECT * FROM nodes WHERE id IS NOT NULL AND type <> 'theory' AND len(list_filter(coalesce(source_block_ids, []), lambda x: CAST(substring(x, 2) AS INTEGER) >= 40)) = 0"),
}


def with_views(body: str, *names: str) -> str:
    """A query with the views it names, and those they name, in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for below in VIEWS[name][0]:
                visit(below)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body
