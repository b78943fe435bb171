"""Document fingerprints by I-Match (native: DataFrame functions only).

The lexicon holds the terms (words) whose share of all documents lies in a band: neither too
common to tell texts apart nor too rare to survive an edit. A text's terms are its distinct
lexicon terms, sorted; where there are none, all its distinct terms. Each of SUBSETS random parts
of the lexicon (a term is in part c at rate 4**-level when certain bits of its hash are zero) gives
one hash of the text's terms in it. A fingerprint holds these hashes from the level on that leaves
about one term in a part, so that an edit spares a share of the hashes close to the share of terms
that it spares. The likeness of two fingerprints is the share of equal hashes among parts that
either fills, at the first two levels that both hold, whatever the sizes of the texts.

The lexicon is broadcast. Every term in it is in at least LOW of all documents, so it has at
most (mean distinct terms of a document) / LOW entries, however many documents there are;
beyond MOST_BROADCAST entries it is joined by shuffling instead.

Defined results: null text is empty; a text without words has the hash of its whole text as its
fingerprint, alike to itself only; rows that repeat an id are documents of their own, in the order
of the md5 of their texts within the id; rows without an id come last; with one document, it is
its own next; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD
from .store import parts, written

SUBSETS = 16
LOW, HIGH = 0.001, 0.1  # the band: shares of documents
MOST_BROADCAST = 2_000_000
LEVELS = 6
NULL = -(2**63)


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, h): terms in the band with a 60-bit hash each; frequencies cover all documents."""
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = docs.select(F.count("*").alias("n"))
    band = counts.crossJoin(F.broadcast(n)).where(F.col("df").between(F.col("n") * LOW, F.col("n") * HIGH))  # n: one row
    return band.select("term", hashed(F.col("term")).alias("h"))


def hashed(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 15), 16, 10).cast("long")


def following(ids: DataFrame, by: int) -> DataFrame:
    """(k, next): the next id in descending order, after the last the first; ids: distinct k.

    Ranges of ids are ordered on their own; one row per range links them."""
    r = written(ids.select("k").repartitionByRange(by, "k").withColumn("p", F.spark_partition_id()), "order")
    tops = r.groupBy("p").agg(F.max("k").alias("top"))
    w = Window.orderBy("p")  # over one row per range
    edge = tops.select("p", F.coalesce(F.lag("top").over(w), F.max("top").over(Window.partitionBy())).alias("below"))
    return r.withColumn("n", F.lead("k").over(Window.partitionBy("p").orderBy(F.col("k").desc()))).join(F.broadcast(edge), "p").select("k", F.coalesce("n", "below").alias("next"))


def prints(terms: str, whole: str) -> Column:
    """The fingerprint of a column of sorted terms (longs): "level:h,h,...;h,h,...;..." with the hashes
    of that level and all above it, an empty place for a part without terms; `whole`, a hash of the
    text, where there are no terms."""
    limits = "".join(f" WHEN size({terms}) <= {2 * 4**i} THEN {i}" for i in range(1, LEVELS))
    level = f"(CASE{limits} ELSE {LEVELS} END)"

    # the masks of the levels are lambda arguments: they are worked out once per text
    part = f"filter({terms}, t -> (shiftrightunsigned(t, c) & m) = 0)"
    one = f"coalesce(substring(md5(nullif(array_join(transform({part}, t -> cast(t AS string)), ','), '')), 1, 8), '')"
    every = f"transform(transform(sequence({level}, {LEVELS + 1}), l -> shiftleft(1L, 2 * l) - 1), m -> array_join(transform(sequence(0, {3 * (SUBSETS - 1)}, 3), c -> {one}), ','))"
    return F.expr(f"CASE WHEN size({terms}) > 0 THEN concat({level}, ':', array_join({every}, ';')) ELSE concat('0:', {whole}) END")


def likeness(a: str, b: str) -> Column:
    """Of two fingerprints in columns a and b, 0 to 1."""
    level = {x: f"cast(substring_index({x}, ':', 1) AS int)" for x in (a, b)}
    first = f"greatest({level[a]}, {level[b]})"
    at = lambda x, i: f"split(get(split(substring_index({x}, ':', -1), ';'), {first} - {level[x]} + {i}), ',')"
    zipped = ", ".join(f"zip_with({at(a, i)}, {at(b, i)}, (x, y) -> struct(x AS x, y AS y))" for i in (0, 1))
    some = f"filter(concat({zipped}), z -> z.x <> '' OR z.y <> '')"
    share = f"coalesce(try_divide(size(filter({some}, z -> z.x = z.y)), size({some})), 0D)"
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {level[a]} = 0 OR {level[b]} = 0 THEN 0D ELSE {share} END")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    lex = written(lexicon(docs), "lexicon")
    small = lex.count() <= MOST_BROADCAST
    by, names = parts(docs.sparkSession), None
    sizes = written(docs.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.count("*").alias("rows")), "sizes")
    if sizes.agg(F.max("rows") > 1).first()[0]:  # ids repeat: places in the order of the rows take their part
        rows = docs.select("k", "text", F.md5("text").alias("m"), F.monotonically_increasing_id().alias("i"))
        rows = rows.repartitionByRange(by, "k", "m", "i").sortWithinPartitions("k", "m")
        named = written(rows.select(F.col("k").alias("id"), "text", F.monotonically_increasing_id().alias("k")), "rows")
        docs, names = named.select("k", "text"), named.select("k", "id")
        sizes = docs.select("k", F.length("text").alias("n"))
    order = written(following(sizes.select("k"), by).join(sizes.select("k", "n"), "k"), "next")
    # each document sends what its predecessor takes of it
    need = order.select(F.col("next").alias("k"), F.col("k").alias("to"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    heads = docs.join(need, "k").select(F.col("to").alias("k"), F.expr("left(text, take)").alias("head"), "take")
    both = docs.join(heads, "k").withColumn("edited", F.concat(F.expr("left(text, length(text) - take)"), F.col("head")))
    lists = both.select("k", F.posexplode(F.array(words(F.col("text")), words(F.col("edited")))).alias("e", "terms"))
    hits = lists.select("k", "e", F.explode("terms").alias("term")).join(F.broadcast(lex) if small else lex, "term")
    own = hits.groupBy("k").agg(*(F.sort_array(F.collect_list(F.when(F.col("e") == i, F.col("h")))).alias(c) for i, c in enumerate(("t0", "t1"))))
    rows = both.select("k", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.md5("text").alias("m0"), F.md5("edited").alias("m1"), "text", "edited")
    rows = rows.join(own, "k", "left")
    # an array of another text is empty, not null, where only one of the two has lexicon terms
    rows = rows.withColumns({c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.sort_array(F.transform(words(F.col(t)), hashed))) for c, t in (("t0", "text"), ("t1", "edited"))})
    rows = rows.withColumns({"fingerprint": prints("t0", "m0"), "edited_fingerprint": prints("t1", "m1")})
    rows = written(rows.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).drop("t0", "t1", "m0", "m1", "text", "edited"), "prints")
    after = rows.select("k", F.col("fingerprint").alias("next_fingerprint")).join(need.select("k", "to"), "k").select(F.col("to").alias("k"), "next_fingerprint")
    out = rows.join(after, "k").withColumn("near_next", likeness("fingerprint", "next_fingerprint"))
    out = out.withColumn("id", F.col("k")) if names is None else out.join(names, "k")
    return out.select(F.when(F.col("id") != NULL, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _sql() -> str:
    level = "(CASE" + "".join(f" WHEN len(t) <= {2 * 4**i} THEN {i}" for i in range(1, LEVELS)) + f" ELSE {LEVELS} END)"

    part = "list_filter(t, lambda v: ((v >> (3 * c)) & ((4 ** l)::BIGINT - 1)) = 0)"
    side = f"array_to_string(list_transform(range(0, {SUBSETS}), lambda c: coalesce(md5(nullif(array_to_string({part}, ','), ''))[1:8], '')), ',')"
    every = f"array_to_string(list_transform(range({level}, {LEVELS + 2}), lambda l: {side}), ';')"

    def like(a: str, b: str) -> str:
        at = lambda x, i: f"string_split({x}.p[greatest({a}.l, {b}.l) - {x}.l + {i}], ',')"
        some = f"list_filter(list_zip(list_concat({at(a, 1)}, {at(a, 2)}), list_concat({at(b, 1)}, {at(b, 2)})), lambda z: z[1] <> '' OR z[2] <> '')"
        return f"""CASE WHEN {a}.f = {b}.f THEN 1.0 WHEN {a}.l = 0 OR {b}.l = 0 THEN 0.0
          ELSE coalesce(len(list_filter({some}, lambda z: z[1] = z[2]))::DOUBLE / nullif(len({some}), 0), 0) END"""

    return f"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS text,
           coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), max(doc_id) OVER ()) AS nxt FROM documents),
d AS (SELECT o.doc_id, o.nxt, o.text, left(o.text, (length(o.text) - length(o.text) // 3)::INT) || left(n.text, (length(o.text) // 3)::INT) AS edited
      FROM o JOIN o n ON o.nxt = n.doc_id),
w AS (SELECT doc_id, 0 AS e, unnest(list_distinct(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS term FROM d
      UNION ALL SELECT doc_id, 1, unnest(list_distinct(regexp_extract_all(edited, '[^\\x20\\x09-\\x0D]+'))) FROM d),
lex AS (SELECT term, ('0x' || md5(term)[1:15])::BIGINT AS h FROM w WHERE e = 0 GROUP BY term
        HAVING count(*) BETWEEN (SELECT count(*) FROM o) * {LOW} AND (SELECT count(*) FROM o) * {HIGH}),
inside AS (SELECT doc_id, e, list_sort(list(h)) AS t FROM w JOIN lex USING (term) GROUP BY ALL),
t AS (FROM inside UNION ALL SELECT doc_id, e, list_sort(list(('0x' || md5(term)[1:15])::BIGINT)) FROM w
      WHERE NOT EXISTS (FROM inside i WHERE i.doc_id = w.doc_id AND i.e = w.e) GROUP BY ALL),
p AS (SELECT b.doc_id, b.e, CASE WHEN t IS NULL THEN '0:' || m ELSE {level} || ':' || {every} END AS f
      FROM (SELECT doc_id, 0 AS e, md5(text) AS m FROM d UNION ALL SELECT doc_id, 1, md5(edited) FROM d) b LEFT JOIN t ON b.doc_id = t.doc_id AND b.e = t.e),
q AS (SELECT *, split_part(f, ':', 1)::INT AS l, string_split(split_part(f, ':', 2), ';') AS p FROM p)
SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, sha256(d.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
  ({like("a", "b")})::DOUBLE AS near_edited, ({like("a", "c")})::DOUBLE AS near_next
FROM d JOIN q a ON a.doc_id = d.doc_id AND a.e = 0 JOIN q b ON b.doc_id = d.doc_id AND b.e = 1 JOIN q c ON c.doc_id = d.nxt AND c.e = 0
"""


SQL = _sql()
