"""Text functions: Column in, Column out. Patterns use ASCII classes unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that count for each citation-context type, in order of precedence.
CONTEXT_TYPES = {
    "limitation_resolution": [r"improv(?:es?|ing)", r"address(?:es|ing)?", r"limitation", r"suffers?\s+from", r"overcome", r"mitigat(?:es?|ing)", r"shortcoming", r"drawback"],
    "comparison": [r"in\s+contrast", r"unlike", r"whereas", r"different\s+from", r"alternatively", r"compar(?:ed?|ing|ison)", r"outperform", r"superior", r"inferior"],
    "evolution": [r"extends?", r"builds?\s+(?:on|upon)", r"modif(?:ies|ying|ied)", r"adapts?", r"generaliz(?:es?|ing)", r"refin(?:es?|ing)", r"augment"],
    "provenance": [r"originally\s+proposed", r"first\s+introduced", r"adapted\s+from", r"inspired\s+by", r"proposed\s+(?:by|in)", r"introduced\s+(?:by|in)", r"pioneer"],
    "evidence_assessment": [r"contradicts?", r"inconsistent\s+with", r"challeng(?:es?|ing)", r"refut(?:es?|ing)", r"conflicts?\s+with", r"calls?\s+into\s+question", r"dampens?"],
    "data_reuse": [r"evaluated?\s+on", r"dataset\s+from", r"benchmark(?:ed|ing)?", r"using\s+the\s+data", r"test(?:ed|ing)?\s+on", r"trained?\s+on", r"fine.?tun(?:ed|ing)\s+on"],
    "background_cite": [r"as\s+shown\s+in", r"demonstrated\s+that", r"found\s+that", r"shown?\s+(?:by|in|that)", r"noted\s+(?:by|in|that)", r"reported\s+(?:by|in|that)", r"observed\s+(?:by|in|that)"],
}
# The relation that each context type stands for.
RELATION_OF = {"evolution": "METHOD", "provenance": "METHOD", "comparison": "RESULT", "data_reuse": "RESULT", "limitation_resolution": "MOTIVE", "evidence_assessment": "MOTIVE", "background_cite": "GROUND", "unclassified": "GROUND"}
# Title words of surveys.
SURVEY_WORDS = ["survey", "review", "tutorial", "overview", "position paper"]
# Header words of sections that matter to a relation.
RELATION_HEADERS = {
    "MOTIVE": ["introduction", "motivation", "challenge", "limitation", "problem"],
    "GROUND": ["related work", "background", "preliminary", "prior work", "overview", "survey"],
    "METHOD": ["method", "approach", "architecture", "framework", "design", "implementation", "model"],
    "RESULT": ["result", "experiment", "evaluation", "ablation", "analysis", "performance", "comparison", "benchmark"],
}
# Header words that put a section first, or second.
FIRST_HEADERS = ["result", "experiment", "evaluation", "analysis", "performance", "ablation", "comparison"]
SECOND_HEADERS = ["method", "approach", "model", "setup", "implementation", "architecture"]


def strip(c: Column) -> Column:
    """Without white space at both ends (not just spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Runs of non-white-space."""
    return F.regexp_extract_all(c, F.lit(r"\S+"), 0)


# What a header's numbering and appendix marks look like.
HEADER_MARKS = (r"^apdx_[a-z][\d.]*:\s*", r"^apdx:\s*", r"^[ivxlc]+-?[a-z]?\s+", r"^[\d.]+\s*")


def normalize_header(c: Column) -> Column:
    """A section header without case, numbering, appendix marks and dashes."""
    c = strip(F.lower(c))
    for pattern in HEADER_MARKS:
        c = F.regexp_replace(c, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[:\-–—]", " "), r"\s+", " "))


def _inside(a: Column, b: Column) -> Column:
    return F.contains(b, a) | F.contains(a, b)


def word_share(query: Column, target: Column) -> Column:
    """Share of the query's distinct words that the target has; 0 below two words."""
    q, t = F.array_distinct(words(query)), F.array_distinct(words(target))
    return F.when((F.size(q) >= 2) & (F.size(t) > 0), F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))


def section_match(query: Column, target: Column) -> Column:
    """Whether two headers mean the same section: one in the other, also normalised, or 60 % of words."""
    qn, tn = normalize_header(query), normalize_header(target)
    both = (F.coalesce(query, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "")
    named = (qn != "") & (tn != "")
    return F.coalesce(both & (_inside(F.lower(query), F.lower(target)) | (named & (_inside(qn, tn) | (word_share(qn, tn) >= 0.6)))), F.lit(False))


def section_keys(header: Column) -> Column:
    """What section_match compares, worked out once per header."""
    n = normalize_header(header)
    return F.struct(F.lower(header).alias("raw"), n.alias("name"), F.array_distinct(words(n)).alias("words"))


def keys_match(query: Column, target: Column) -> Column:
    """section_match of two section_keys; the word arrays only where nothing cheaper decides."""
    q, t = query, target
    both = (F.coalesce(q["raw"], F.lit("")) != "") & (F.coalesce(t["raw"], F.lit("")) != "")
    named = (q["name"] != "") & (t["name"] != "")
    shared = F.size(F.array_intersect(q["words"], t["words"])) / F.size(q["words"])
    close = F.when((F.size(q["words"]) >= 2) & (F.size(t["words"]) > 0), shared >= 0.6).otherwise(F.lit(False))
    return F.coalesce(both & F.when(_inside(q["raw"], t["raw"]), F.lit(True)).when(~named, F.lit(False)).when(_inside(q["name"], t["name"]), F.lit(True)).otherwise(close), F.lit(False))


def section_alias(i: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, 702 -> AAA, ... for every int."""
    n, first, out = i.cast("long"), 0, None
    for width in range(1, 8):  # seven letters reach beyond the largest int
        rest = n - first
        alias = F.concat(*(F.char(65 + F.floor(rest / 26**k) % 26) for k in range(width - 1, -1, -1)))
        first += 26**width
        out = F.when(n < first, alias) if out is None else out.when(n < first, alias)
    return out


def alias_index(alias: Column) -> Column:
    """The inverse of section_alias; letters in upper case."""
    return F.aggregate(F.split(alias, ""), F.lit(0).cast("long"), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64)) - 1


def option_letter(i: Column) -> Column:
    return F.when(i.between(0, 3), F.char(65 + i)).otherwise(F.lit("?"))


def answer_index(answer: Column) -> Column:
    """0 to 3 for a bare option letter, perhaps in brackets or with a mark after it; else -1."""
    letter = F.upper(F.regexp_extract(answer, r"(?i)^\s*\(?([ABCD])\)?\s*[.:)]?\s*$", 1))
    return F.when(letter != "", F.ascii(letter) - 65).otherwise(F.lit(-1)).cast("int")


def word_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))


def numbers(c: Column) -> Column:
    """Distinct numbers in a text that say something (not 0 to 5)."""
    trivial = F.array(*(F.lit(str(i)) for i in range(6)))
    return F.array_except(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+\.?\d*"), 0)), trivial)


def numeric_overlap(a: Column, b: Column) -> Column:
    """Share of a's numbers that b has; 0 unless both have two."""
    x, y = numbers(a), numbers(b)
    return F.when((F.size(x) >= 2) & (F.size(y) >= 2), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def citations_in(context: Column) -> Column:
    """Papers cited in a context: parts between semicolons of bracketed years; 1 at least."""
    groups = F.regexp_extract_all(context, F.lit(r"\([^)]*\d{4}[^)]*\)"), 0)
    n = F.aggregate(groups, F.lit(0), lambda s, g: s + F.size(F.split(g, ";")))
    return F.greatest(n, F.lit(1))


def specificity(contexts: Column) -> Column:
    """The fewest citations of any context; 99 without contexts."""
    return F.coalesce(F.array_min(F.transform(contexts, citations_in)), F.lit(99))


def context_type(text: Column) -> Column:
    """The type with most patterns that occur; the earlier of equals; 'unclassified' without any."""
    scored = [F.struct(sum((F.rlike(text, F.lit("(?i)" + p)).cast("int") for p in ps), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, ps) in enumerate(CONTEXT_TYPES.items())]
    return F.array_max(F.array(*scored, F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit("unclassified").alias("t"))))["t"]


def relation(types: Column) -> Column:
    """The relation most of the context types stand for; the first seen of equals; GROUND without any."""
    known = F.create_map(*(F.lit(x) for kv in RELATION_OF.items() for x in kv))
    each = F.transform(types, lambda t: F.coalesce(F.element_at(known, t), F.lit("GROUND")))
    counted = F.transform(F.array_distinct(each), lambda r: F.struct(F.size(F.filter(each, lambda x: x == r)).alias("n"), (-F.array_position(each, r)).alias("o"), r.alias("r")))
    return F.coalesce(F.array_max(counted)["r"], F.lit("GROUND"))


def is_survey(title: Column, kinds: Column | None = None) -> Column:
    """Whether the title has a survey word or the publication types have Review."""
    by_title = F.coalesce(F.rlike(F.lower(title), F.lit("|".join(SURVEY_WORDS))), F.lit(False))
    return by_title if kinds is None else by_title | F.coalesce(F.array_contains(kinds, "Review"), F.lit(False))


def has_cjk(c: Column) -> Column:
    return F.coalesce(F.rlike(c, F.lit(r"[\x{3000}-\x{9fff}\x{ac00}-\x{d7af}]")), F.lit(False))


def answer_keywords(c: Column, most: int = 8) -> Column:
    """Up to five numbers, three runs of capitalised words, three acronyms; so many in all."""
    find = lambda p, n: F.slice(F.regexp_extract_all(c, F.lit(p), 0), 1, n)
    acronyms = F.filter(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), 0), lambda w: w.rlike("^[A-Z]{2,}$"))
    return F.slice(F.concat(find(r"\d+\.?\d*%?", 5), find(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", 3), F.slice(acronyms, 1, 3)), 1, most)


def found_in(keywords: Column, text: Column) -> Column:
    """How many of the keywords the text contains."""
    return F.size(F.filter(keywords, lambda k: F.contains(text, k)))


def claim_terms(c: Column) -> Column:
    """All numbers and the first five words of four letters or more, in lower case."""
    return F.concat(F.regexp_extract_all(c, F.lit(r"\d+\.?\d*%?"), 0), F.slice(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]{4,}"), 0), F.lower), 1, 5))


def claim_band(terms: Column, text: Column) -> Column:
    """confirmed from half of the terms, partial from one, else no_match; skipped without terms."""
    share = F.try_divide(F.size(F.filter(terms, lambda t: F.contains(text, F.lower(t)))), F.size(terms))
    return F.when(F.size(terms) == 0, F.lit("skip_no_terms")).when(share >= 0.5, F.lit("confirmed")).when(share > 0, F.lit("partial")).otherwise(F.lit("no_match"))


def cut(c: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def sentence_cut(c: Column, most: int = 500, least: int = 200) -> Column:
    """Texts over `most` characters end at the last sentence end before it, if that is past `least`."""
    head = F.substring(c, 1, most)
    last = F.length(head) - F.locate(" .", F.reverse(head)) - 1  # where ". " begins, from 0
    ended = (F.locate(" .", F.reverse(head)) > 0) & (last > least)
    return F.when(F.length(c) <= most, c).when(ended, F.substring(head, F.lit(1), last + 1)).otherwise(head)


def clean_brackets(c: Column) -> Column:
    """[ 20 ] -> [20] and [ 20 , 4 ] with one separator between its parts."""
    one = F.regexp_replace(c, r"\[\s*(\d+)\s*\]", "[$1]")
    inner = F.regexp_extract_all(one, F.lit(r"\[\s*[\d\s,]+\s*\]"), 0)
    tidy = lambda g: F.concat(F.lit("["), F.array_join(F.regexp_extract_all(F.substring(g, F.lit(2), F.length(g) - 2), F.lit(r"\S+"), 0), ", "), F.lit("]"))
    return F.aggregate(F.array_distinct(inner), one, lambda s, g: F.replace(s, g, tidy(g)))


def paragraphs(c: Column) -> Column:
    """Parts between blank lines, without the empty ones."""
    return F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")


def table_text(caption: Column, rows: Column) -> Column:
    """A table (rows: arrays of cells) as lines with bars between cells, after its caption."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.array_join(F.concat(F.array(F.concat(F.lit("Table: "), F.coalesce(caption, F.lit("")))), lines), "\n")


def claimed(header: Column, section: Column) -> Column:
    """Whether a header is the section a claim names: section_match, an empty header included."""
    return (F.coalesce(header, F.lit("")) == F.coalesce(section, F.lit(""))) | section_match(section, header)


def author_short(names: Column) -> Column:
    """One name, two names, or the first and et al.; Unknown without any."""
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit("Unknown")).when(F.size(names) == 1, F.get(names, F.lit(0))).when(F.size(names) == 2, F.concat(F.get(names, F.lit(0)), F.lit(" and "), F.get(names, F.lit(1)))).otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))


def context_list(contexts: Column, most: int = 3) -> Column:
    """Contexts numbered for a prompt."""
    lines = F.transform(F.slice(contexts, 1, most), lambda c, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit('] "'), c, F.lit('"')))
    return F.when(F.size(contexts) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(no citation context available)"))


def is_transient(error: Column) -> Column:
    """Whether an error is worth a retry."""
    return F.coalesce(F.rlike(error, F.lit("429|(?i:rate|quota|overloaded)|RESOURCE_EXHAUSTED|500|502|503")), F.lit(False))
