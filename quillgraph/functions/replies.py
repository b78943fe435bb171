"""What models reply, as Columns: JSON in prose, answers, channel marks; and what they are told."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace, if that is JSON; else null."""
    part = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(part).isNotNull() & (part != ""), part)


def fenced_json(reply: Column) -> Column:
    """The whole reply if it is JSON, else the JSON of its first code fence, else null."""
    fence = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(F.when(F.try_parse_json(reply).isNotNull(), reply), F.when((fence != "") & F.try_parse_json(fence).isNotNull(), fence))


def answer_of(values: Column, named: Column | None = None) -> Column:
    """A to D from the values of a reply (array of strings, in order) and its field `answer`: that
    field, else a value that is one letter, else a phrase that names one, else a letter at the end."""
    up = lambda c: F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    letter = lambda c: F.when(F.rlike(up(c), F.lit("^[ABCD]$")), up(c))
    phrase = r"""(?i)(?:answer\s*(?:is|:)\s*|select\s+|choose\s+|option\s+)["']?\b([A-D])\b"""
    prose = lambda c: F.when(F.length(c) > 1, F.coalesce(F.nullif(F.upper(F.regexp_extract(c, phrase, 1)), F.lit("")), F.nullif(F.upper(F.regexp_extract(F.regexp_replace(c, r"\s+$", ""), r"(?i)\b([A-D])\)?\s*$", 1)), F.lit(""))))
    first = lambda f: F.get(F.filter(F.transform(values, f), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(letter(named) if named is not None else F.lit(None).cast("string"), first(letter), first(prose))


# The marks of channels.
CHANNEL, MESSAGE, END = "<|channel|>", "<|message|>", "<|end|>"
MARKS = ("channel", "message", "end", "constrain", "start")


def without_channels(text: Column) -> Column:
    """The bodies of final channels; without any, what stands outside of channels. A channel lasts from
    its mark to the next end mark; marks that belong to none go with the words up to the next "<"."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    after = lambda c, mark: F.substring(c, F.locate(mark, c) + len(mark), F.length(c))
    closed = F.split(text, r"<\|end\|>")  # all but the last end in a mark

    def part(s: Column, i: Column) -> Column:
        block = after(s, CHANNEL)
        whole = (i < F.size(closed) - 1) & F.contains(s, F.lit(CHANNEL)) & F.contains(block, F.lit(MESSAGE)) & F.rlike(block, F.lit(r"^\w"))
        outside = F.when(whole, F.substring_index(s, CHANNEL, 1)).when(i < F.size(closed) - 1, F.concat(s, F.lit(END))).otherwise(s)
        return F.struct(whole.alias("whole"), F.regexp_extract(block, r"^\w+", 0).alias("kind"), trim(after(block, MESSAGE)).alias("body"), outside.alias("outside"))

    parts = F.transform(closed, part)
    final = F.transform(F.filter(parts, lambda p: p["whole"] & (p["kind"] == "final")), lambda p: p["body"])
    pieces = F.split(F.array_join(F.transform(parts, lambda p: p["outside"]), ""), "<")
    marked = lambda x: F.exists(F.array(*(F.lit(f"|{m}|>") for m in MARKS)), lambda m: F.startswith(x, m))
    rest = F.array_join(F.filter(F.transform(pieces, lambda x, i: F.when(i == 0, x).when(~marked(x), F.concat(F.lit("<"), x))), lambda x: x.isNotNull()), "")
    return F.when(~F.contains(text, F.lit(CHANNEL)), text).when(F.size(final) > 0, F.array_join(final, "\n")).otherwise(trim(rest))


def status_line(turn: Column, tokens: Column, used: Column) -> Column:
    """Counters after a tool result."""
    return F.concat(F.lit("\nTurn: "), (turn + 1).cast("string"), F.lit("  |  Tokens used: "), F.format_number(tokens, 0), F.lit("  |  Budget used: "), used.cast("string"))


def choice_prompt(context: Column, question: Column, options: Column) -> Column:
    """A multiple-choice prompt: context, question, lettered options."""
    lines = F.transform(options, lambda o, i: F.concat(F.char(65 + i), F.lit(". "), o))
    return F.concat_ws("\n\n", F.concat(F.lit("Context:\n"), context), F.concat(F.lit("Question: "), question), F.concat(F.lit("Options:\n"), F.array_join(lines, "\n")), F.lit('Reply as JSON: {"answer": "<letter>"}'))
