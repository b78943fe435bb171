"""Fill-in-middle transformation by escaped marker injection (DataFrame functions only).

A text is cut into units (runs of letters, other characters one by one). A delimiter is escaped
in the text, `regexp_replace` appends it after every unit, so that its count is the number of
units, and `substring_index` takes the parts by the ranks of their units. The parts are
unescaped and put together behind their markers. No row meets another: there is no shuffle.

The cuts, the form and the order of parts come from the sha256 of a seed and doc_id, so they
repeat in any engine and on any cluster. A text that holds a marker stays plain, hence markers
split an output in one way only, and `restored` rebuilds the text from output and form alone: a
marker begins with "<", ends with ">" and has neither inside, so none arises across a border.

Defined results: a null text is empty; an empty text is plain with n = 0; a null doc_id is hashed
as no digits; rows that repeat an id are cut by the same numbers; texts of any length are whole;
an empty table gives an empty result; other columns are kept unless one has the name (names ignore
case) of a result column, which then replaces it; helper columns have names that no column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import spare_names

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
END, ESC = "\x01", "\x02"  # the delimiter, and what stands for it in a text
UNIT = "[A-Za-z]+|[^A-Za-z]"
PLAIN, SPM = 90, 20  # of 100: from here on texts stay plain; below, the suffix comes first
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC), F.lit(ESC + "0")), F.lit(END), F.lit(ESC + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESC + "1"), F.lit(END)), F.lit(ESC + "0"), F.lit(ESC))


def draw(i: int, seed: str = "1", doc_id: str = "doc_id") -> Column:
    """The i-th (from 1) group of eight hex digits of the sha256 of "seed:doc_id", as a number."""
    h = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(h, 8 * i - 7, 8), 16, 10).cast("long")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, from an output and its form."""
    o, f = F.col(output), F.col(form)
    after = lambda c, m: F.substring_index(c, m, -1)
    before = lambda c, m: F.substring_index(c, m, 1)
    head = before(o, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), after(o, MIDDLE), after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), after(o, MIDDLE), after(before(head, PREFIX), SUFFIX))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)


def infilled(docs: DataFrame, seed: str = "1", plain: int = PLAIN, spm: int = SPM, unit: str = UNIT) -> DataFrame:
    """docs (doc_id, text, ...) with n (units), form (plain, psm or spm), prefix_chars and middle_chars
    (code points, null where plain), output and restored."""
    spare = spare_names(docs)
    text, ends, a, b = (spare(c) for c in ("text_", "ends", "a", "b"))
    parts = {c: spare(c) for c in ("prefix", "middle", "suffix")}
    d = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    d = d.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn(ends, F.regexp_replace(escaped(F.col(text)), f"{ESC}[01]|{unit}", f"$0{END}"))
    d = d.withColumn("n", F.length(ends).cast("long") - F.length(F.replace(F.col(ends), F.lit(END), F.lit(""))))
    cuts = [draw(i, seed) % (F.col("n") + 1) for i in (1, 2)]
    d = d.withColumns({a: F.least(*cuts), b: F.greatest(*cuts)})
    marked = F.col(text).contains(PREFIX) | F.col(text).contains(SUFFIX) | F.col(text).contains(MIDDLE)
    stays = (F.col(text) == "") | marked | (draw(3, seed) % 100 >= plain)
    d = d.withColumn("form", F.when(stays, "plain").when(draw(4, seed) % 100 < spm, "spm").otherwise("psm"))
    # the last unit ends in a delimiter too, so counting from the right begins one after it
    ranked = {
        "prefix": f"substring_index(`{ends}`, '{END}', int(`{a}`))",
        "middle": f"substring_index(substring_index(`{ends}`, '{END}', int(`{b}`)), '{END}', -int(`{b}` - `{a}`))",
        "suffix": f"substring_index(`{ends}`, '{END}', -int(n - `{b}` + 1))",
    }
    d = d.withColumns({parts[k]: F.when(F.col("form") != "plain", unescaped(F.replace(F.expr(v), F.lit(END), F.lit("")))) for k, v in ranked.items()})
    p, m, s = (F.col(parts[c]) for c in ("prefix", "middle", "suffix"))
    psm = F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)
    spm_ = F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m)
    d = d.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col(text)))
    d = d.withColumns({"prefix_chars": F.length(p).cast("long"), "middle_chars": F.length(m).cast("long"), "restored": restored()})
    return d.drop(text, ends, a, b, *parts.values())


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
             sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
             WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(u[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
