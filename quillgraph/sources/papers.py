"""Paper pages as sections and tables, relationally: tags are rows, elements are intervals.

A page is cut into tokens, one row each. Running sums over the tags of a name give each start tag its
level, and with it the end tag at that level; an element whose end tag is missing ends with the innermost
closed element around it, and of end tags without a start tag nothing remains. Running sums over all
starts and ends give depths. Sections, headings, table cells and texts then meet by joins on the page
and on positions inside intervals. A page may be of any length; rows of different pages never meet.

The steps are SQL, written once for both engines that run it (`Dialect`): Spark keeps the tables that
several steps read in the shared folder, and `sql_of` gives the same steps as one statement with CTEs.
Spark deals pages to tasks by page once; `dealt_steps` are its steps, which move no row from then on.

Defined results: a null page is empty, and pages without sections have empty arrays; where two elements cross, each
ends at its own end tag; script and style texts belong to no section, but do to a header's part where they
follow it directly; rows that repeat a key are not told apart, so keys must be distinct.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import bucketed, staying

# Sections that are left out, by how their header begins.
LEFT_OUT = ("references", "bibliography", "acknowledgement", "acknowledgment", "acknowledg", "checklist", "version control", "author contrib", "contributions", "ethics", "ethical", "disclosure of funding", "broader impact", "impact statement", "reproducibility", "summary of contributions", "список литературы")
# How headers of appendices begin.
APPENDIX = ("appendix", "supplementary", "приложение")

_NO_END = tuple("area base br col embed hr img input link meta param source track wbr".split())
_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ENDS = rf"^{_WS}+|{_WS}+\z"
_ATTRS = r'(?:[^"\x27>]+|"[^"]*"|\x27[^\x27]*\x27)*'
_RAW = "|".join(rf"<{n}\b[^>]*>.*?(?:</{n}[^>]*>|\z)" for n in ("script", "style"))
_ENTITY = "&(?:#[0-9]+;?|#x[0-9a-f]+;?|[a-z][a-z0-9]{1,31};?)"
_TOKEN = rf"(?is)<!--.*?(?:-->|\z)|{_RAW}|<[!?][^>]*>|</?[a-z]{_ATTRS}>|{_ENTITY}|(?:[^<&]+|<[^a-z/!?<&])+|[<&]"
_NAME, _SCRIPT = r"^</?([a-zA-Z][^/>\s]*)", r"(?is)^<(?:script|style)\b"
_CLASS = r'(?i)\sclass\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^>\s]+)'
_END = 1 << 30
# How many bytes of pages a task takes, and how many tasks there are at most.
TASK_BYTES, MOST_TASKS = 4 << 20, 100_000


@dataclass(frozen=True)
class Dialect:
    regex: Callable[[str], str]  # a pattern as a literal
    tokens: str  # (k, i, tok) of pages (k, html)
    found: Callable[[str, str], str]
    stripped: Callable[[str], str]
    group1: str  # in a replacement
    joined: Callable[[str, str, str], str]  # values with a separator, in an order
    listed: Callable[[str, str], str]
    unicode: Callable[[str], str]  # the character of a number
    hexed: Callable[[str], str]
    struct: Callable[[str, str, str, str], str]
    none: str
    begins: str  # a function: whether a text begins with another
    gap: str  # two newlines


def _spark_rx(p: str) -> str:
    return f"r'{p}'"


SPARK = Dialect(
    _spark_rx, f"SELECT k, posexplode(regexp_extract_all(html, {_spark_rx(_TOKEN)}, 0)) AS (i, tok) FROM pages", lambda a, p: f"regexp_like({a}, {_spark_rx(p)})",
    lambda a: f"regexp_replace({a}, {_spark_rx(_ENDS)}, '')", "$1", lambda a, s, o: f"string_agg({a}, {s}) WITHIN GROUP (ORDER BY {o})",
    lambda a, o: f"transform(array_sort(collect_list(struct({o} AS o, {a} AS v))), x -> x.v)", lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')", lambda h: f"cast(conv({h}, 16, 10) AS bigint)",
    lambda n, a, m, b: f"named_struct('{n}', {a}, '{m}', {b})", "array()", "startswith", r"'\n\n'",
)


def _duck_rx(p: str) -> str:
    return f"'{p}'"


DUCKDB = Dialect(
    _duck_rx, f"SELECT k, unnest(range(len(t))) AS i, unnest(t) AS tok FROM (SELECT k, regexp_extract_all(html, {_duck_rx(_TOKEN)}) AS t FROM pages_)", lambda a, p: f"regexp_matches({a}, {_duck_rx(p)})",
    lambda a: f"regexp_replace({a}, {_duck_rx(_ENDS)}, '', 'g')", r"\1", lambda a, s, o: f"string_agg({a}, {s} ORDER BY {o})",
    lambda a, o: f"list({a} ORDER BY {o})", lambda n: f"chr({n}::INT)", lambda h: f"('0x' || {h})::BIGINT", lambda n, a, m, b: f"{{'{n}': {a}, '{m}': {b}}}","[]", "starts_with", "chr(10) || chr(10)",
)


def entity_rows() -> list[tuple[str, str]]:
    """Names of character references (without &) and what they stand for, and numbers that do not stand for themselves."""
    odd = [0, 13, *range(128, 160)]
    return sorted(html5.items()) + [(f"#{n}", html.unescape(f"&#{n};")) for n in odd]


# Numbering before a header, and numbered appendix headers.
ROMAN, NUMBERED = "^[IVXLC]+([A-Z])", rf"^([AS])\.(\p{{Nd}}+){_WS}*(.*)"
DIGITS = rf"^[\p{{Nd}}.]+{_WS}*"


def _clean(d: Dialect, raw: str) -> str:
    """The header without numbering, appendices marked Apdx."""
    rep = lambda x, p, by="''": f"regexp_replace({x}, {d.regex(p)}, {by})"
    ex = lambda x, p, g=1: f"regexp_extract({x}, {d.regex(p)}, {g})"
    h = rep(rep(raw, ROMAN, f"'{d.group1}'"), DIGITS)
    rest = rep(rep(rep(h, f"(?i)^(?:{'|'.join(APPENDIX)})"), f"^{_WS}*:?{_WS}*"), DIGITS)
    lettered = d.stripped(rep(f"substring({rest}, 2)", f"^(?:{_WS}|:)*"))
    titled = lambda mark, title: f"CASE WHEN {title} <> '' THEN concat({mark}, ': ', {title}) ELSE {mark} END"
    marked = f"CASE WHEN {d.found(rest, '^[A-Z]')} THEN {titled(f'''concat('Apdx_', substring({rest}, 1, 1))''', lettered)} ELSE {titled(chr(39) + 'Apdx' + chr(39), d.stripped(rest))} END"
    numbered = titled(f"concat('Apdx_', {ex(h, NUMBERED)}, '.', {ex(h, NUMBERED, 2)})", d.stripped(ex(h, NUMBERED, 3)))
    return f"CASE WHEN {d.found(h, f'(?i)^(?:{chr(124).join(APPENDIX)})')} THEN {marked} WHEN {d.found(h, NUMBERED)} THEN {numbered} ELSE {h} END"


def _left_out(d: Dialect, header: str) -> str:
    return d.found(header, rf"(?i)^(?:{'|'.join(LEFT_OUT)})|^[^\n]*paper checklist")


def steps(d: Dialect) -> list[tuple[str, str, bool]]:
    """(name, statement over pages (k, html) and earlier steps, whether several later steps read it)."""
    rep = lambda x, p, by="''": f"regexp_replace({x}, {d.regex(p)}, {by})"
    cut = lambda x: rep(x, DIGITS)
    roman = rep("h.raw", ROMAN, f"'{d.group1}'")
    number = f"CASE WHEN lower(e.tok) LIKE '&#x%' THEN {d.hexed(rep(rep('lower(e.tok)', '^&#x0*(.*)', chr(39) + '0' + d.group1 + chr(39)), ';$'))} ELSE cast({rep(rep('e.tok', '^&#0*(.*)', chr(39) + '0' + d.group1 + chr(39)), ';$')} AS bigint) END"
    heading = d.found("name", "^h[1-6]$")
    return [
        ("tok", d.tokens, False),
        ("tags", f"""SELECT k, i, tok, lower(regexp_extract(tok, {d.regex(_NAME)}, 1)) AS name,
           CASE WHEN {d.found('tok', f'(?i)^{_ENTITY}$')} THEN 'entity' WHEN NOT {d.found('tok', '^<[a-zA-Z/!?]')} OR tok = '</' THEN 'text' WHEN {d.found('tok', _SCRIPT)} THEN 'raw'
             WHEN {d.found('tok', '^<[a-zA-Z]')} THEN CASE WHEN {d.found('tok', '(?s)/>$')} OR lower(regexp_extract(tok, {d.regex(_NAME)}, 1)) IN {_NO_END} THEN 'void' ELSE 'open' END
             WHEN {d.found('tok', '^</[a-zA-Z]')} THEN 'close' ELSE 'other' END AS kind FROM tok""", True),
        ("sums", "SELECT k, i, name, kind, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY k, name ORDER BY i) AS s FROM tags WHERE kind IN ('open', 'close')", False),
        ("lows", "SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY k, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM sums", False),
        ("levels", "SELECT k, i, name, kind, CASE kind WHEN 'open' THEN s - low ELSE s - low + 1 END AS lvl FROM lows WHERE kind = 'open' OR s >= low", False),
        ("next", "SELECT *, lead(kind) OVER w AS nk, lead(i) OVER w AS ni FROM levels WINDOW w AS (PARTITION BY k, name, lvl ORDER BY i)", False),
        ("opens", "SELECT k, i AS a, name, CASE WHEN nk = 'close' THEN ni END AS b FROM next WHERE kind = 'open'", True),
        ("ended", f"""SELECT o.k, o.a, o.name, coalesce(o.b, e.b, {_END}) AS b FROM opens o
           LEFT JOIN (SELECT u.k, u.a, min(c.b) AS b FROM opens u JOIN opens c ON u.k = c.k AND u.a > c.a AND u.a < c.b WHERE u.b IS NULL AND c.b IS NOT NULL GROUP BY u.k, u.a) e ON o.k = e.k AND o.a = e.a""", True),
        ("moves", f"""SELECT k, i, max(tok) AS tok, max(kind) AS kind, max(name) AS name, sum(d) AS d, sum(x) AS x FROM (
           SELECT k, i, tok, kind, name, CASE WHEN kind = 'open' THEN 1 ELSE 0 END AS d, CASE WHEN kind = 'open' AND name IN ('annotation', 'annotation-xml') THEN 1 ELSE 0 END AS x FROM tags
           UNION ALL SELECT k, b, NULL, NULL, NULL, -1, CASE WHEN name IN ('annotation', 'annotation-xml') THEN -1 ELSE 0 END FROM ended WHERE b < {_END}) m GROUP BY k, i""", False),
        ("placed", """SELECT k, i, tok, kind, name, sum(d) OVER w AS depth, sum(x) OVER w AS dropped, sum(CASE WHEN kind IN ('text', 'entity') THEN 0 ELSE 1 END) OVER w AS gap
           FROM moves WINDOW w AS (PARTITION BY k ORDER BY i)""", False),
        ("nodes", "SELECT * FROM placed WHERE dropped = 0", True),
        ("elements", f"""SELECT n.k, n.i AS a, coalesce(e.b, n.i) AS b, n.name, n.depth + CASE WHEN n.kind = 'open' THEN 0 ELSE 1 END AS depth,
           CASE WHEN n.kind = 'raw' THEN '' ELSE regexp_extract(n.tok, {d.regex(_CLASS)}, 1) END AS kinds
           FROM nodes n LEFT JOIN ended e ON n.k = e.k AND n.i = e.a WHERE n.kind IN ('open', 'void', 'raw')""", True),
        ("known", f"""SELECT tok, max_by(v, n) AS v FROM (
           SELECT e.tok, length(x.name) AS n, concat(x.v, substring(e.tok, 2 + length(x.name))) AS v FROM (SELECT DISTINCT tok FROM nodes WHERE kind = 'entity') e
             JOIN entities x ON substring(e.tok, 2, 2) = substring(x.name, 1, 2) AND {d.begins}(substring(e.tok, 2), x.name) WHERE x.name NOT LIKE '#%'
           UNION ALL SELECT tok, 0, coalesce(x.v, CASE WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE {d.unicode('n')} END)
             FROM (SELECT tok, CASE WHEN length(tok) > 12 THEN 1114112 ELSE {number} END AS n FROM (SELECT DISTINCT tok FROM nodes WHERE kind = 'entity' AND tok LIKE '&#%') e) e
             LEFT JOIN entities x ON x.name = concat('#', cast(n AS VARCHAR(9)))) z GROUP BY tok""".replace("chr(65533)", d.unicode("65533")), False),
        ("texts", f"""SELECT * FROM (SELECT k, min(i) AS i, max(depth) AS depth, {d.stripped(d.joined('coalesce(q.v, n.tok)', "''", 'i'))} AS s, false AS raw
             FROM nodes n LEFT JOIN known q ON n.tok = q.tok AND n.kind = 'entity' WHERE kind IN ('text', 'entity') GROUP BY k, gap
           UNION ALL SELECT k, i, depth, {d.stripped(rep(rep('tok', '(?s)^<[^>]*>'), '(?is)</(?:script|style)[^>]*>$'))}, true FROM nodes WHERE kind = 'raw') t WHERE s <> ''""", True),
        ("heads", f"""SELECT *, {cut('raw')} AS cut FROM (SELECT h.k, h.a, h.b, h.name, h.depth, coalesce({d.joined('t.s', "''", 't.i')}, '') AS raw
           FROM elements h LEFT JOIN texts t ON h.k = t.k AND t.i > h.a AND t.i < h.b AND NOT t.raw WHERE {heading.replace('name', 'h.name')} GROUP BY h.k, h.a, h.b, h.name, h.depth) x""", True),
        ("secs", """SELECT s.k, s.a, s.b, min(CASE WHEN h.depth = s.depth + 1 THEN h.a END) AS own, min(h.a) AS sub, count(DISTINCT o.a) AS above
           FROM elements s LEFT JOIN heads h ON s.k = h.k AND h.a > s.a AND h.a < s.b LEFT JOIN (SELECT * FROM elements WHERE name = 'section') o ON s.k = o.k AND s.a > o.a AND s.a < o.b
           WHERE s.name = 'section' GROUP BY s.k, s.a, s.b""", True),
        ("ranked", """SELECT s.*, h.name AS level, count(CASE WHEN h.name = 'h2' THEN 1 END) OVER w AS n2, count(CASE WHEN h.name = 'h3' THEN 1 END) OVER w AS n3
           FROM secs s LEFT JOIN heads h ON s.k = h.k AND s.own = h.a WINDOW w AS (PARTITION BY s.k)""", False),
        ("chosen", """SELECT k, a, b, CASE WHEN n2 + n3 = 0 THEN sub ELSE own END AS head FROM ranked
           WHERE CASE WHEN n2 <= 1 AND n3 > n2 THEN level = 'h3' WHEN n2 > 0 THEN level = 'h2' ELSE above = 0 AND sub IS NOT NULL END""", False),
        ("kept", f"""SELECT c.k, c.a, c.b, h.raw, {_clean(d, 'h.raw')} AS header FROM chosen c JOIN heads h ON c.k = h.k AND c.head = h.a WHERE NOT {_left_out(d, cut(roman))}""", True),
        ("gone", f"""SELECT DISTINCT x.k, x.a, x.b FROM secs x JOIN heads h ON x.k = h.k AND x.sub = h.a JOIN kept c ON x.k = c.k AND x.a > c.a AND x.a < c.b WHERE {_left_out(d, 'h.cut')}""", False),
        ("words", "SELECT t.* FROM texts t LEFT ANTI JOIN gone g ON t.k = g.k AND t.i > g.a AND t.i < g.b" if d is SPARK else "SELECT t.* FROM texts t ANTI JOIN gone g ON t.k = g.k AND t.i > g.a AND t.i < g.b", True),
        ("own", f"""SELECT k, a, header, CASE WHEN {d.begins}(body, raw) THEN {d.stripped('substring(body, length(raw) + 1)')} ELSE body END AS body FROM (
           SELECT c.k, c.a, c.header, c.raw, {d.joined('t.s', "' '", 't.i')} AS body FROM kept c JOIN words t ON c.k = t.k AND t.i > c.a AND t.i < c.b AND NOT t.raw GROUP BY c.k, c.a, c.header, c.raw) x""", False),
        ("mains", "SELECT * FROM own WHERE body <> ''", True),
        ("alone", "SELECT h.* FROM heads h LEFT JOIN (SELECT DISTINCT k FROM mains) m ON h.k = m.k WHERE m.k IS NULL", False),
        ("parts", f"""SELECT k, a, b, depth, cut, least(pb, coalesce(lead(a) OVER (PARTITION BY k, pa, depth ORDER BY a), {_END})) AS stop FROM (
           SELECT h.k, h.a, h.b, h.depth, h.cut, coalesce(max(p.a), -1) AS pa, coalesce(max(p.b), {_END}) AS pb
           FROM alone h LEFT JOIN elements p ON h.k = p.k AND h.a > p.a AND h.a < p.b AND p.depth = h.depth - 1 GROUP BY h.k, h.a, h.b, h.depth, h.cut) x""", False),
        ("pieces", f"""SELECT p.k, p.a, p.cut, e.a AS ea, {d.joined('t.s', "' '", 't.i')} AS s FROM parts p JOIN elements e ON p.k = e.k AND e.a > p.b AND e.a < p.stop AND e.depth = p.depth
           JOIN words t ON e.k = t.k AND (t.i > e.a AND t.i < e.b AND NOT t.raw OR t.i = e.a) WHERE NOT {_left_out(d, 'p.cut')} GROUP BY p.k, p.a, p.cut, e.a""", False),
        ("found", f"SELECT k, a, header, body FROM mains UNION ALL SELECT k, a, cut, {d.joined('s', d.gap, 'ea')} FROM pieces GROUP BY k, a, cut", False),
        ("cells", f"""SELECT c.k, r.a AS ra, c.a, coalesce({d.joined('t.s', "''", 't.i')}, '') AS s FROM elements r JOIN elements c ON r.k = c.k AND c.a > r.a AND c.a < r.b AND c.name IN ('td', 'th')
           LEFT JOIN texts t ON c.k = t.k AND t.i > c.a AND t.i < c.b AND NOT t.raw WHERE r.name = 'tr' GROUP BY c.k, r.a, c.a""", False),
        ("lines", f"SELECT k, ra, {d.listed('s', 'a')} AS line FROM cells GROUP BY k, ra", False),
        ("grids", f"""SELECT t.k, t.a, count(*) AS n, {d.listed('l.line', 'l.ra')} AS grid FROM elements t JOIN lines l ON t.k = l.k AND l.ra > t.a AND l.ra < t.b WHERE t.name = 'table' GROUP BY t.k, t.a""", True),
        ("marked", """SELECT w.k, w.a, min(CASE WHEN e.name = 'table' THEN e.a END) AS ta, min(CASE WHEN e.kinds LIKE '%caption%' THEN e.a END) AS ca FROM elements w JOIN elements e ON w.k = e.k AND e.a > w.a AND e.a < w.b
           WHERE w.kinds LIKE '%ltx!_table%' ESCAPE '!' OR w.kinds LIKE '%table-wrapper%' GROUP BY w.k, w.a""", False),
        ("framed", f"""SELECT m.k, m.a, coalesce({d.joined('t.s', "''", 't.i')}, '') AS caption, max(g.a) AS ta FROM marked m JOIN grids g ON m.k = g.k AND m.ta = g.a
           LEFT JOIN elements c ON m.k = c.k AND m.ca = c.a LEFT JOIN texts t ON c.k = t.k AND t.i > c.a AND t.i < c.b AND NOT t.raw GROUP BY m.k, m.a""", True),
        ("tabs", """SELECT f.k, f.a, f.caption, g.grid FROM framed f JOIN grids g ON f.k = g.k AND f.ta = g.a
           UNION ALL SELECT g.k, g.a, '', g.grid FROM grids g LEFT JOIN (SELECT DISTINCT k FROM framed) f ON g.k = f.k WHERE f.k IS NULL AND g.n > 1""", False),
        ("result", f"""SELECT p.k, coalesce(s.sections, {d.none}) AS sections, coalesce(t.tables, {d.none}) AS tables FROM pages p
           LEFT JOIN (SELECT k, {d.listed(d.struct('header', 'header', 'text', 'body'), 'a')} AS sections FROM found GROUP BY k) s ON p.k = s.k
           LEFT JOIN (SELECT k, {d.listed(d.struct('caption', 'caption', 'rows', 'grid'), 'a')} AS tables FROM tabs GROUP BY k) t ON p.k = t.k""", False),
    ]


def sql_of(pages: str) -> str:
    """CTEs, up to result (k, sections, tables), for DuckDB; pages: a statement that gives (k, html)."""
    rows = ", ".join(f"('{n}', '{v.replace(chr(39), chr(39) * 2)}')" for n, v in entity_rows())
    every = [("pages_", pages), ("entities", f"SELECT * FROM (VALUES {rows}) v(name, v)")]
    every += [(n, s.replace("FROM pages p", "FROM pages_ p")) for n, s, _ in steps(DUCKDB)]
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in every)


def dealt_steps() -> list[tuple[str, str, bool]]:
    """Spark's steps over pages that are dealt by page: without unions, which lose how rows are dealt; references are
    looked up in the broadcast table, by their whole name or number or by the longest short name they begin with, and
    steps that join by more than the page are kept."""
    d = SPARK
    rep = lambda x, p, by="''": f"regexp_replace({x}, {d.regex(p)}, {by})"
    digits = lambda p: rep(rep("lower(tok)", p, f"'0{d.group1}'"), ";$")
    number = f"CASE WHEN length(tok) > 12 THEN 1114112 WHEN lower(tok) LIKE '&#x%' THEN {d.hexed(digits('^&#x0*(.*)'))} ELSE cast({digits('^&#0*(.*)')} AS bigint) END"
    short = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    other = f"CASE WHEN num BETWEEN 55296 AND 57343 OR num > 1114111 THEN {d.unicode('65533')} ELSE {d.unicode('num')} END"
    own = {
        "moves": f"""SELECT t.k, t.i, t.tok, t.kind, t.name, CASE WHEN t.kind = 'open' THEN 1 ELSE 0 END - coalesce(e.n, 0) AS d,
           CASE WHEN t.kind = 'open' AND t.name IN ('annotation', 'annotation-xml') THEN 1 ELSE 0 END - coalesce(e.x, 0) AS x
           FROM tags t LEFT JOIN (SELECT k, b, count(*) AS n, count(CASE WHEN name IN ('annotation', 'annotation-xml') THEN 1 END) AS x FROM ended WHERE b < {_END} GROUP BY k, b) e ON t.k = e.k AND t.i = e.b""",
        "known": f"""SELECT n.k, n.i, n.tok, n.kind, n.depth, n.gap, CASE WHEN n.num IS NOT NULL THEN coalesce(x.v, {other.replace('num', 'n.num')})
             WHEN x.name IS NOT NULL THEN x.v WHEN y.name IS NOT NULL THEN concat(y.v, substring(n.tok, 2 + length(y.name))) ELSE n.tok END AS v
           FROM (SELECT *, CASE WHEN num IS NOT NULL THEN concat('#', num) WHEN kind = 'entity' THEN substring(tok, 2) END AS whole,
             CASE WHEN kind = 'entity' AND num IS NULL THEN regexp_extract(tok, {d.regex(f'^&({short})')}, 1) END AS short
             FROM (SELECT *, CASE WHEN kind = 'entity' AND tok LIKE '&#%' THEN {number} END AS num FROM nodes WHERE kind IN ('text', 'entity', 'raw')) m) n
           LEFT JOIN entities x ON n.whole = x.name LEFT JOIN entities y ON n.short = y.name""",
        "texts": f"""SELECT * FROM (SELECT k, min(i) AS i, max(depth) AS depth,
             CASE WHEN kind = 'raw' THEN {d.stripped(rep(rep('max(tok)', '(?s)^<[^>]*>'), '(?is)</(?:script|style)[^>]*>$'))} ELSE {d.stripped(d.joined('v', "''", 'i'))} END AS s, kind = 'raw' AS raw
             FROM (SELECT k, i, tok, depth, gap, v, CASE WHEN kind = 'raw' THEN kind ELSE 'text' END AS kind FROM known) n GROUP BY k, gap, kind) t WHERE s <> ''""",
        "framed": next(s for n, s, _ in steps(d) if n == "framed").replace("c.k = t.k", "m.k = t.k"),  # c may be missing
        "tabs": "SELECT f.k, f.a, f.caption, g.grid FROM framed f JOIN grids g ON f.k = g.k AND f.ta = g.a",
        # the caller's job, so hints keep its joins from broadcasting
        "result": f"""SELECT /*+ MERGE(m, s, t, g) */ p.k, coalesce(m.sections, s.sections, {d.none}) AS sections, coalesce(t.tables, g.tables, {d.none}) AS tables FROM pages p
           LEFT JOIN (SELECT k, {d.listed(d.struct('header', 'header', 'text', 'body'), 'a')} AS sections FROM mains GROUP BY k) m ON p.k = m.k
           LEFT JOIN (SELECT k, {d.listed(d.struct('header', 'cut', 'text', 'body'), 'a')} AS sections FROM (SELECT k, a, cut, {d.joined('s', d.gap, 'ea')} AS body FROM pieces GROUP BY k, a, cut) x GROUP BY k) s ON p.k = s.k
           LEFT JOIN (SELECT k, {d.listed(d.struct('caption', 'caption', 'rows', 'grid'), 'a')} AS tables FROM tabs GROUP BY k) t ON p.k = t.k
           LEFT JOIN (SELECT k, {d.listed(d.struct('caption', "''", 'rows', 'grid'), 'a')} AS tables FROM grids WHERE n > 1 GROUP BY k) g ON p.k = g.k""",
    }
    return [(n, own.get(n, s), shared or n in ("pieces", "tabs")) for n, s, shared in steps(d) if n != "found"]


def parse_papers(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages (key, html) as (key, sections: array of header and text, tables: array of caption and rows)."""
    spark: SparkSession = pages.sparkSession
    d = pages.select(F.col(key).alias("k"), F.col(html).alias("html"))
    size = d.agg(F.sum(F.octet_length("html"))).head()[0] or 0
    n = min(MOST_TASKS, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    known = {"pages": d.repartition(n, "k"), "entities": F.broadcast(spark.createDataFrame(entity_rows(), "name string, v string"))}
    with staying(spark):
        for name, statement, shared in dealt_steps():
            text = _with_frames(statement, known)
            df = spark.sql(text, **{x: known[x] for x in known if f"{{{x}}}" in text})
            known[name] = bucketed(df, name, n, "k") if shared else df
    return known["result"].withColumnRenamed("k", key)


def _with_frames(statement: str, known: dict) -> str:
    """Names of earlier steps after FROM and JOIN as fields for the frames."""
    out = []
    before = ""
    for word in statement.replace("{", "{{").replace("}", "}}").split(" "):
        name = word.rstrip(")\n")
        out.append(f"{{{name}}}{word[len(name):]}" if before in ("FROM", "JOIN") and name in known else word)
        before = word.strip().rpartition("\n")[2]
    return " ".join(out)


def counted(papers: DataFrame) -> DataFrame:
    """Parsed papers that have sections, with the numbers of their sections and tables."""
    return papers.where(F.size("sections") > 0).withColumns({"n_sections": F.size("sections"), "n_tables": F.size("tables")})
