"""What the tools answer an agent, and the prompts of the agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.sections import match_section
from quillgraph.functions.text import section_alias
from quillgraph.operators.replay import TOOL_COSTS, tool_cost

# The parameters each tool cannot do without, and the wording of the answers.
NEEDED = {"get_paper_info": ["paper_id"], "get_references": ["paper_id"], "search_papers": ["query"], "list_sections": ["paper_id"], "read_section": ["paper_id", "section"], "think": [], "submit_answer": ["answer"]}
NO_PAPER = "Paper '%s' not found in the available paper pool."
NO_TEXT = "Full text not available for paper '%s'."
ONLY_ABSTRACT = " Only abstract is available via get_paper_info."
NO_SECTIONS = "No sections found for paper '%s'."
NOTED = "Noted."
SUBMITTED = "Answer submitted: %s"
UNKNOWN = "Unknown tool: %s"
MISSING = "Error calling %s: Missing or invalid parameter — '%s'"
REJECTED = "REJECTED: %s costs %s points, %s left."


def _say(form: str, *parts: Column) -> Column:
    return F.format_string(form, *parts)


def paper_info(paper_id: Column, known: Column, title: Column, authors: Column, year: Column, abstract: Column, has_text: Column) -> Column:
    """A paper's metadata as text; one line where the pool does not know it."""
    or_ = lambda c, other: F.coalesce(c.cast("string"), F.lit(other))
    lines = [
        F.concat(F.lit("Title: "), or_(title, "Unknown")), F.concat(F.lit("Authors: "), or_(authors, "Unknown")), F.concat(F.lit("Year: "), or_(year, "Unknown")),
        F.concat(F.lit("Abstract: "), F.coalesce(F.when(abstract != "", abstract), F.lit("(not available)"))), F.concat(F.lit("Full text available: "), F.when(has_text, "Yes").otherwise("No")),
    ]
    return F.when(known, F.concat_ws("\n", *lines)).otherwise(_say(NO_PAPER, paper_id))


def _without_text(paper_id: Column, known: Column, sections: Column, more: str, found: Column) -> Column:
    return (
        F.when(sections.isNull() & ~known, _say(NO_PAPER, paper_id)).when(sections.isNull(), _say(NO_TEXT + more, paper_id))
        .when(F.size(sections) == 0, _say(NO_SECTIONS, paper_id)).otherwise(found)
    )


def section_list(paper_id: Column, known: Column, sections: Column, tables: Column) -> Column:
    """The sections (array of header, text; null without full text) with aliases, lengths and the number of tables."""
    head = F.concat(F.lit("Sections for paper '"), paper_id, F.lit("' ("), F.size(sections).cast("string"), F.lit(" sections):\n"))
    each = F.transform(sections, lambda s, i: F.concat(F.lit("  ("), section_alias(i), F.lit(") "), F.coalesce(s["header"], F.concat(F.lit("Section "), (i + 1).cast("string"))), F.lit(" ("), F.length(F.coalesce(s["text"], F.lit(""))).cast("string"), F.lit(" chars)")))
    more = F.when(tables > 0, F.array(F.concat(F.lit("\n  Tables: "), tables.cast("string"), F.lit(" available")))).otherwise(F.array().cast("array<string>"))
    return _without_text(paper_id, known, sections, ONLY_ABSTRACT, F.array_join(F.concat(F.array(head), each, more), "\n"))


def section_text(paper_id: Column, known: Column, sections: Column, section: Column) -> Column:
    """The section an alias, a header or a part of one header means, or the list of what there is."""
    at = match_section(section, sections)
    hit = F.get(sections, at)
    names = F.array_join(F.transform(sections, lambda s, i: F.concat(F.lit("("), section_alias(i), F.lit(") "), F.coalesce(s["header"], F.lit("")))), "; ")
    none = F.concat(F.lit("Section '"), section, F.lit("' not found in paper '"), paper_id, F.lit("'.\nAvailable sections: "), names)
    return _without_text(paper_id, known, sections, "", F.when(at.isNotNull(), F.concat(F.lit("=== "), hit["header"], F.lit(" ===\n\n"), hit["text"])).otherwise(none))


def dispatched(tool: Column, args: Column, answers: dict[str, Column]) -> Column:
    """The output of a call (args: map of strings): an unknown tool and a parameter that is missing have
    messages of their own; `answers` has the texts of the tools that look something up."""
    own = {"think": F.lit(NOTED), "submit_answer": _say(SUBMITTED, F.element_at(args, "answer")), **answers}
    out = F.when(~tool.isin(*TOOL_COSTS), _say(UNKNOWN, tool))
    for name, needed in NEEDED.items():
        for p in needed:
            out = out.when((tool == name) & ~F.coalesce(F.map_contains_key(args, p), F.lit(False)), _say(MISSING, tool, F.lit(p)))
        if name in own:
            out = out.when(tool == name, own[name])
    return out


def called(calls: DataFrame, answers: dict[str, Column], left: Column | None = None) -> DataFrame:
    """calls (tool, args, ...) with output and cost; with `left`, a call beyond it is rejected for nothing."""
    cost = tool_cost(F.col("tool"))
    output = dispatched(F.col("tool"), F.col("args"), answers)
    if left is not None:
        over = (cost > left) & (F.col("tool") != "submit_answer")
        output = F.when(over, _say(REJECTED, F.col("tool"), cost.cast("string"), left.cast("string"))).otherwise(output)
        cost = F.when(over, 0).otherwise(cost)
    return calls.withColumns({"output": output, "cost": cost})


def system_prompt(parts: list[tuple[str, str | None]], disabled: Column) -> Column:
    """Lines of a prompt (text, the tool it is about or null) without those of disabled tools (array)."""
    lines = [F.when(F.lit(True) if tool is None else ~F.array_contains(disabled, tool), F.lit(text)) for text, tool in parts]
    return F.concat_ws("\n", *lines)


def result_envelope(tool: Column, output: Column, left: Column) -> Column:
    """A tool's output for models that call tools by text."""
    return F.concat(F.lit('<tool_result name="'), tool, F.lit('">\n'), output, F.lit("\n</tool_result>\n[budget left: "), left.cast("string"), F.lit("]"))
