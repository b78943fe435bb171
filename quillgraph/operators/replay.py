"""Replay of recorded tool calls under a budget, as one fold per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each tool costs.
TOOL_COSTS = {"get_paper_info": 1, "get_references": 1, "search_papers": 1, "list_sections": 1, "read_section": 5, "submit_answer": 0, "think": 0}


def tool_cost(tool: Column) -> Column:
    """Unknown tools cost nothing."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in TOOL_COSTS.items() for x in kv)), tool), F.lit(0))


def budget_machine(calls: str, budget: int = 30, stop_after: int = 2, disabled: tuple[str, ...] = ()) -> Column:
    """Folds an ordered array of structs (turn, tool) into a struct: left, ran, rejected, run of
    rejections, submitted, stopped, turn.

    A disabled tool is refused and leaves the run of rejections as it is. A call that costs more
    than what is left is rejected and adds to the run (submit_answer never); any other call is
    paid for and ends the run. All calls of a turn are made before the run is looked at: from
    stop_after on, later turns are not made. After a turn with an answer nothing follows."""
    off = f"array_contains(array({', '.join(repr(d) for d in disabled)}), x.tool)" if disabled else "false"
    costs = ", ".join(f"'{k}', {v}" for k, v in TOOL_COSTS.items())
    cost = f"coalesce(element_at(map({costs}), x.tool), 0)"
    halted = f"(s.stopped OR (x.turn > s.turn AND (s.run >= {stop_after} OR s.submitted)))"
    over = f"({cost} > s.left AND x.tool <> 'submit_answer')"
    fold = f"""aggregate({calls},
      named_struct('left', {budget}, 'ran', 0, 'rejected', 0, 'run', 0, 'submitted', false, 'stopped', false, 'turn', -1),
      (s, x) -> CASE WHEN {halted} THEN named_struct('left', s.left, 'ran', s.ran, 'rejected', s.rejected, 'run', s.run, 'submitted', s.submitted, 'stopped', true, 'turn', s.turn)
        WHEN {off} THEN named_struct('left', s.left, 'ran', s.ran, 'rejected', s.rejected + 1, 'run', s.run, 'submitted', s.submitted, 'stopped', false, 'turn', int(x.turn))
        WHEN {over} THEN named_struct('left', s.left, 'ran', s.ran, 'rejected', s.rejected + 1, 'run', s.run + 1, 'submitted', s.submitted, 'stopped', false, 'turn', int(x.turn))
        ELSE named_struct('left', s.left - {cost}, 'ran', s.ran + 1, 'rejected', s.rejected, 'run', 0, 'submitted', s.submitted OR x.tool = 'submit_answer', 'stopped', false, 'turn', int(x.turn)) END)"""
    return F.expr(fold)


def calls_of(rows: DataFrame, sample: str, order: list[str]) -> DataFrame:
    """(sample, calls): each sample's calls (turn, tool) in order. A sample's calls are bounded by its
    turn limit, so collecting them is too."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col("turn"), F.col("tool"))))
    return rows.groupBy(sample).agg(F.transform(items, lambda x: F.struct(x["turn"].alias("turn"), x["tool"].alias("tool"))).alias("calls"))


def terminated_by(state: str, tokens: Column, errors: Column, token_limit: int = 200_000) -> Column:
    """Why a run ended, from the folded state and its totals."""
    s = F.col(state)
    return F.when(errors > 0, F.lit("error")).when(s["submitted"], F.lit("answer")).when(tokens > token_limit, F.lit("token_limit")).when(s["run"] >= 2, F.lit("budget")).otherwise(F.lit("max_turns"))
