"""Papers from an index: searches with filters, seeds by tier, lookups, fields that sources name differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.construction import eligible_seeds
from quillgraph.operators.sampling import stratified_quota

PAGES, PER_PAGE = 10, 1000


def search_bulk(papers: DataFrame, venue: str | None = None, years: tuple[int, int] | None = None, citations: int | None = None, pages: int = PAGES, per_page: int = PER_PAGE) -> DataFrame:
    """Papers (venue, year, citationCount, pos) that a search with these filters returns: the first pages
    in order of pos. The filters are plain predicates, so they reach a Parquet scan."""
    d = papers
    if venue is not None:
        d = d.where(F.col("venue") == venue)
    if years is not None:
        d = d.where(F.col("year").between(*years))
    if citations:
        d = d.where(F.col("citationCount") >= citations)
    return d.orderBy("pos").limit(pages * per_page)


def tier_seeds(papers: DataFrame, excluded: DataFrame, years: tuple[int, int], citations: int, target: int, venues: list[str]) -> DataFrame:
    """Seeds of one tier: eligible papers of the venues (each paper once, for its first venue in their
    order), all of them up to target; beyond it the most cited of each venue, an equal number, then the
    most cited of the rest."""
    order = F.create_map(*(F.lit(x) for i, v in enumerate(venues) for x in (v, i)))
    d = papers.where(F.col("venue").isin(*venues) & F.col("year").between(*years) & (F.coalesce("citationCount", F.lit(0)) >= citations))
    place = F.struct(F.element_at(order, F.col("venue")).alias("v"), F.col("pos").alias("p"))
    ok = eligible_seeds(d.withColumn("at", F.col("pos")).withColumn("pos", place), excluded).withColumn("pos", F.col("at")).drop("at")
    n = ok.agg(F.countDistinct("venue").alias("venues"), F.count("*").alias("n")).first()
    best = [F.coalesce("citationCount", F.lit(0)).desc(), F.element_at(order, F.col("venue")), F.col("pos")]
    return ok if n["n"] <= target else stratified_quota(ok, "venue", best, target, max(1, n["venues"]))


def first_nonempty(keys: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """Per key all rows of the first source that has any for it, with `source`, its number."""
    every = None
    for i, s in enumerate(sources):
        one = s.withColumn("source", F.lit(i))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    best = every.groupBy(key).agg(F.min("source").alias("source"))
    return keys.select(key).join(best, key).join(every, [key, "source"])


def lookup(papers: DataFrame, ids: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The listed fields of papers by id; ids that are unknown keep nulls."""
    return ids.select(key).distinct().join(papers.select(key, *fields), key, "left")


def fetched(first: Column, status: Column, second: Column, status2: Column, least: int = 1000) -> Column:
    """The page of the first address if it was served and longer than `least`, else of the second, else null."""
    good = lambda page, code: F.when((code == 200) & (F.length(page) > least), page)
    return F.coalesce(good(first, status), good(second, status2))


def arxiv_id(external: Column, own: Column) -> Column:
    """The id among a paper's external ids (map), else its own field, else empty."""
    return F.coalesce(F.nullif(F.element_at(external, "ArXiv"), F.lit("")), F.nullif(own, F.lit("")), F.lit(""))


def renamed(value: Column, names: dict[str, str]) -> Column:
    """A venue's short name where there is one."""
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(known, value), value)


def missing_filled(rows: DataFrame, key: str, value: str, source: DataFrame) -> DataFrame:
    """Rows with an empty value get the source's for their key, each key looked up once."""
    need = rows.where(F.coalesce(F.col(value), F.lit("")) == "").select(key).distinct()
    got = need.join(source.groupBy(key).agg(F.max(value).alias("_got")), key)
    return rows.join(got, key, "left").withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_got"))).drop("_got")


def contents(wanted: DataFrame, pool: DataFrame, pages: DataFrame, parse) -> DataFrame:
    """Content of the wanted ids (id): from the pool (id, content) where known, else parsed from pages
    (id, html), each page once, and given back with `fresh` so that a caller can add it to the pool."""
    ids = wanted.select("id").distinct()
    known = ids.join(pool.select("id", "content"), "id").withColumn("fresh", F.lit(False))
    rest = ids.join(pool.select("id"), "id", "left_anti").join(pages.dropDuplicates(["id"]).select("id", "html"), "id")
    return known.unionByName(rest.select("id", parse(F.col("html")).alias("content"), F.lit(True).alias("fresh")))


def most_groups(pairs: DataFrame, keys: list[str], order: list[Column], most: int = 8) -> DataFrame:
    """The best `most` groups of each seed, or of each other key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
