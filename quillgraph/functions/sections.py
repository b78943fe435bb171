"""Functions of a paper's sections: arrays of structs (header, text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import FIRST_HEADERS, RELATION_HEADERS, SECOND_HEADERS, alias_index, normalize_header, section_alias, section_match, strip


def _has_any(header: Column, keywords: list[str]) -> Column:
    return F.rlike(F.lower(header), F.lit("|".join(keywords)))


def relevant(sections: Column, relation: str, least: int = 500) -> Column:
    """Sections whose headers suit a relation; all of them if these hold too few characters."""
    some = F.filter(sections, lambda s: _has_any(s["header"], RELATION_HEADERS[relation]))
    n = F.aggregate(some, F.lit(0), lambda t, s: t + F.coalesce(F.length(s["text"]), F.lit(0)))
    return F.when(n < least, sections).otherwise(some)


def ordered(sections: Column) -> Column:
    """Results first, then methods, then the rest, each in order."""
    rank = lambda s: F.when(_has_any(s["header"], FIRST_HEADERS), 0).when(_has_any(s["header"], SECOND_HEADERS), 1).otherwise(2)
    keyed = F.array_sort(F.transform(sections, lambda s, i: F.struct(rank(s).alias("r"), i.alias("i"), s.alias("s"))))
    return F.transform(keyed, lambda x: x["s"])


def as_text(sections: Column) -> Column:
    return F.array_join(F.transform(ordered(sections), lambda s: F.concat(F.lit("### "), s["header"], F.lit("\n"), s["text"])), "\n\n")


def match_section(query: Column, sections: Column) -> Column:
    """The 0-based section a query means: letter alias, equal header, equal normalised header, the only
    header that holds it, the only normalised header that does; null otherwise."""
    q = strip(query)
    letters = F.regexp_extract(F.upper(q), r"^\(?([A-Z]{1,3})\)?$", 1)
    at = F.when(letters != "", alias_index(letters))
    low, norm = F.lower(q), normalize_header(q)
    places = F.transform(sections, lambda s, i: F.struct(i.alias("i"), s["header"].alias("h"), normalize_header(s["header"]).alias("n")))
    first = lambda test: F.get(F.filter(places, test), F.lit(0))["i"]
    only = lambda test: F.when(F.size(F.filter(places, test)) == 1, first(test))
    found = F.coalesce(
        F.when((at >= 0) & (at < F.size(sections)), at.cast("int")), first(lambda p: F.lower(strip(p["h"])) == low), F.when(norm != "", first(lambda p: p["n"] == norm)),
        only(lambda p: F.contains(F.lower(p["h"]), low)), F.when(norm != "", only(lambda p: F.contains(p["n"], norm))),
    )
    return F.when(q != "", found)


def listing(sections: Column) -> Column:
    """Sections with their aliases and lengths, a line each."""
    return F.array_join(F.transform(sections, lambda s, i: F.concat(F.lit("("), section_alias(i), F.lit(") "), s["header"], F.lit(" ["), F.length(s["text"]).cast("string"), F.lit(" chars]"))), "\n")


def any_match(sections: Column, query: Column) -> Column:
    """Whether any section's header matches the query."""
    return F.exists(sections, lambda s: section_match(query, s["header"]))


def oversized(sections: Column, most: int = 70_015) -> Column:
    return F.exists(sections, lambda s: F.length(s["text"]) > most)


def without_oversized(sections: Column, most: int = 70_015, gold: Column | None = None) -> Column:
    """Sections without oversized ones; those of gold papers (true in `gold`) stay as they are."""
    slim = F.filter(sections, lambda s: F.length(s["text"]) <= most)
    return slim if gold is None else F.when(F.coalesce(gold, F.lit(False)), sections).otherwise(slim)


def capped_text(sections: Column, cap: int = 15_000) -> Column:
    """Sections as one text; those of the appendix share a budget of characters."""
    cut = lambda s, left: F.when(F.length(s["text"]) > left, F.concat(F.substring(s["text"], F.lit(1), left), F.lit("\n[...truncated, "), (F.length(s["text"]) - left).cast("string"), F.lit(" chars omitted]"))).otherwise(s["text"])
    line = lambda h, t: F.concat(F.lit("\n## "), h, F.lit("\n"), t)

    def fold(state: Column, s: Column) -> Column:
        left = F.lit(cap) - state["used"]
        appendix = F.startswith(s["header"], F.lit("Apdx"))
        text = cut(s, left)
        skip = appendix & (left <= 0)
        out = F.when(skip, state["out"]).otherwise(F.concat(state["out"], F.array(line(s["header"], F.when(appendix, text).otherwise(s["text"])))))
        return F.struct((state["used"] + F.when(appendix & ~skip, F.length(text)).otherwise(0)).alias("used"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(sections, zero, fold, lambda s: F.array_join(s["out"], "\n"))
