"""Tool calls written as text by models, in several notations, as a table function.

One scanner finds groups of brackets, minding quotes; a notation says where to look: between tags, in
fences, behind a channel mark, or anywhere. All notations are looked for, and the calls of the first one in
their order that has any are the calls of the text. `SELECT ... FROM t, LATERAL tool_calls(t.text)`
reaches it from SQL once `register` has run; a second argument names other tools.

Defined results: null and empty texts, broken JSON, unknown tools and unbalanced brackets give no call;
arguments that are no object count as none, and a text that should be one but is not stays as `_raw`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillgraph.operators.replay import TOOL_COSTS

# The marks of the notations.
TAGS = ("<tool_call>", "</tool_call>")
FENCE, FENCED_JSON, FENCED_CODE = "```", ("tool_call", "json"), ("tool_code",)
CHANNEL, TO, MESSAGE = "<|channel|>", "to=functions.", "<|message|>"
PAIRS = {"(": ")", "[": "]", "{": "}"}

Found = tuple[str, dict]


def group_end(text: str, at: int, quotes: str) -> int:
    """Where the group that opens at this place ends (its closing bracket's place plus 1), 0 if nowhere."""
    open_, quote, skip = [], "", False
    for i in range(at, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in quotes:
            quote = c
        elif c in PAIRS:
            open_.append(PAIRS[c])
        elif open_ and c == open_[-1]:
            open_.pop()
            if not open_:
                return i + 1
    return 0


def groups(text: str, bracket: str, quotes: str) -> Iterator[str]:
    """Outermost groups in order that begin like an object or a list of calls; where one does not close,
    what is inside is looked at."""
    at = text.find(bracket)
    while at >= 0:
        then = text[at + 1 : at + 200].lstrip()
        likely = then[:1] == '"' if bracket == "{" else then[len(word(then)) :].lstrip()[:1] == "("
        end = group_end(text, at, quotes) if likely else 0
        if end:
            yield text[at:end]
        at = text.find(bracket, end or at + 1)


def value_of(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def from_object(text: str) -> Iterator[Found]:
    d = value_of(text)
    if isinstance(d, dict) and isinstance(d.get("name"), str):
        args = d.get("arguments", {})
        if isinstance(args, str):
            inner = value_of(args)
            args = {"_raw": args} if inner is None else inner
        yield d["name"], args if isinstance(args, dict) else {}


def word(text: str) -> str:
    """The letters, digits and underscores at the beginning."""
    n = next((i for i, c in enumerate(text) if not (c.isalnum() or c == "_")), len(text))
    return text[:n]


def named_values(text: str) -> dict:
    """key=value between commas: quoted texts and whole numbers; anything else is left out."""
    out, start, quote = {}, 0, ""
    for i, c in enumerate(text + ","):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == ",":
            key, _, v = (x.strip() for x in text[start:i].partition("="))
            if len(v) > 1 and v[0] in "'\"" and v[-1] == v[0]:
                out[key] = v[1:-1]
            elif v.isdecimal():
                out[key] = int(v)
            start = i + 1
    return out


def from_line(line: str) -> Iterator[Found]:
    name, line = word(line), line.strip()
    rest = line[len(name) :].lstrip()
    if name and rest[:1] == "(" and rest[-1:] == ")":
        yield name, named_values(rest[1:-1])


def from_list(body: str) -> Iterator[Found]:
    """Nothing but calls, with commas between."""
    out = []
    while body := body.lstrip(" \t\r\n,"):
        name = word(body)
        rest = body[len(name) :].lstrip()
        end = group_end(rest, 0, "'\"") if name and rest[:1] == "(" else 0
        if not end:
            return
        out.append((name, named_values(rest[1 : end - 1])))
        body = rest[end:]
    yield from out


def lines(text: str) -> Iterator[str]:
    return (s for x in text.splitlines() if (s := x.strip()) and not s.startswith("#"))


def looked_up(text: str) -> Iterator[tuple[int, Found]]:
    """(number of the notation, call)."""
    for part in text.split(TAGS[0])[1:]:
        body, closed, _ = part.partition(TAGS[1])
        yield from ((0, c) for c in from_object(body) if closed)
    for block in text.split(FENCE)[1::2]:
        kind, _, body = block.partition("\n")
        if kind.strip() in FENCED_JSON:
            yield from ((1, c) for c in from_object(body))
        elif kind.strip() in FENCED_CODE:
            yield from ((2, c) for x in lines(body) for c in from_line(x))
    for part in text.split(CHANNEL)[1:]:
        head, said, body = part.partition(MESSAGE)
        body = body.lstrip()
        if said and TO in head and body[:1] == "{":
            args = value_of(body[: body.find("}") + 1])
            yield 3, (word(head.partition(TO)[2]), args if isinstance(args, dict) else {})
    yield from ((4, c) for g in groups(text, "{", '"') if '"arguments"' in g for c in from_object(g))
    yield from ((5, c) for x in lines(text) for c in from_line(x))
    yield from ((6, c) for g in groups(text, "[", "'\"") for c in from_list(g[1:-1]))


def parse(text: str | None, tools=TOOL_COSTS) -> list[Found]:
    """The calls of known tools in a text."""
    known = [(n, c) for n, c in looked_up(text or "") if c[0] in tools]
    first = min((n for n, _ in known), default=None)
    return [c for n, c in known if n == first]


class ToolCalls:
    """tool_calls(text [, tools]): id (text_1, text_2, ...), name and args of the calls in a text."""

    @staticmethod
    def analyze(text: AnalyzeArgument, tools: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("tool_calls: the first argument is a text")
        if tools is not None and not (isinstance(tools.dataType, ArrayType) and isinstance(tools.dataType.elementType, StringType)):
            raise ValueError("tool_calls: the second argument is an array of names")
        return AnalyzeResult(StructType().add("id", StringType()).add("name", StringType()).add("args", MapType(StringType(), StringType())))

    def eval(self, text: str, tools: list | None = None) -> Iterator[tuple]:
        if text and ("(" in text or "{" in text):
            for i, (name, args) in enumerate(parse(text, TOOL_COSTS if tools is None else tools), 1):
                yield f"text_{i}", name, {k: str(v) for k, v in args.items()}


def register(spark: SparkSession) -> None:
    """tool_calls for statements of this session."""
    spark.udtf.register("tool_calls", F.udtf(ToolCalls))


def maybe_calls(text: Column) -> Column:
    """A cheap condition that texts without calls fail, to keep them from Python."""
    return F.contains(text, F.lit("(")) | F.contains(text, F.lit("{"))
