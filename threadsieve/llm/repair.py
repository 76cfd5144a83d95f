"""Repair of conversation structure by weighted CYK interval parsing.

Legal conversations follow ``(s?(ua)+)?`` over the initials of their roles. The grammar is in Chomsky normal form: a
nonterminal ``(p, q)`` stands for the turns that lead from state p to state q, its binary rules are ``(p, q) -> (p, r) (r, q)``, and
its terminals are single rows, kept, given another role, or deleted. Insertions are closed over each terminal, on both
sides. A cell of the chart holds, for every nonterminal, the least (cost, audit) of its span, and cells are
combined bottom-up by span length. Of audits that cost the same none begins another (both edit the same rows, and one
more insertion would cost more), so the least audit of a span is made of the least audits of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
# Where a role's initial leads from a state; 0 begins, 3 follows an assistant, 0 and 3 may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# Spans up to this many rows try every split; longer ones one, since a derivation can be split between any two rows.
CHART_ROWS = 16
# Cells of short spans that a task keeps for the next conversation.
KEPT_CELLS = 200_000
LOOK = r"\x20\x09-\x0D"

Cell = dict[tuple[int, int], tuple[int, str]]


def least(*cells: Cell) -> Cell:
    out: Cell = {}
    for cell in cells:
        for span, found in cell.items():
            if span not in out or found < out[span]:
                out[span] = found
    return out


def joined(left: Cell, right: Cell) -> Cell:
    """All binary rules over two neighbouring spans."""
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, tail) in right.items():
            if r == s:
                found = (cost + more, audit + tail)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def insertions() -> Cell:
    """The span of no rows: what insertions alone can do."""
    one: Cell = {(p, q): (INSERT_COST, "I") for (p, role), q in STEPS.items() if role != "s"}
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        more = least(cell, joined(cell, one))
        if more == cell:
            return cell
        cell = more


INSERTED = insertions()


def terminal(symbol: str) -> Cell:
    """The span of one row: ``x`` must go; ``s u a o`` may stay, a capital with the cost of a truncated row."""
    cell: Cell = {(p, p): (DELETE_COST, "D") for p in range(4)}
    if symbol != "x":
        extra = TRUNCATED_COST if symbol.isupper() else 0
        keep = {(p, q): (extra, "K") for (p, role), q in STEPS.items() if role == symbol.lower()}
        other = {(p, q): (extra + REROLE_COST, "R") for (p, role), q in STEPS.items() if role != "s"}
        cell = least(cell, keep, other)
    return joined(INSERTED, joined(cell, INSERTED))


def chart(symbols: str, cells: dict[str, Cell]) -> Cell:
    """The cell of all of ``symbols``, spans of one row first. Spans of equal rows share a cell."""
    for symbol in symbols:
        if symbol not in cells:
            cells[symbol] = terminal(symbol)
    for length in range(2, len(symbols) + 1):
        for start in range(len(symbols) - length + 1):
            span = symbols[start:start + length]
            if span not in cells:
                cells[span] = least(*[joined(cells[span[:cut]], cells[span[cut:]]) for cut in range(1, length)])
    return cells[symbols]


def parse(symbols: str, cells: dict[str, Cell]) -> tuple[int, str]:
    """Least cost and its least audit for the rows of a conversation, one symbol each."""
    row = [chart(symbols[i:i + CHART_ROWS], cells) for i in range(0, len(symbols), CHART_ROWS)] or [INSERTED]
    while len(row) > 1:
        row = [joined(*row[i:i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return min(row[0][end] for end in ((0, 0), (0, 3)) if end in row[0])


def picks(audit: str) -> tuple[list[int], list[str]]:
    """For each turn of the repaired conversation its row (from 1; 0: inserted) and its new role (empty: its own).

    The last turn is an assistant's and roles alternate, so the audit alone tells every new role.
    """
    left, row, rows, roles = len(audit) - audit.count("D"), 0, [], []
    for edit in audit:
        row += edit != "I"
        if edit == "D":
            continue
        left -= 1
        rows.append(row if edit != "I" else 0)
        roles.append("" if edit == "K" else "user" if left % 2 else "assistant")
    return rows, roles


def parsed(symbols: Column) -> Column:
    """``cost, audit, at, roles`` of rows written as symbols."""
    @F.pandas_udf("cost long, audit string, at array<int>, roles array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cells: dict[str, Cell] = {}
        for batch in batches:
            out = []
            for text in batch:
                if len(cells) > KEPT_CELLS:
                    cells.clear()
                cost, audit = parse(text, cells)
                out.append((cost, audit, *picks(audit)))
            yield pd.DataFrame(out, columns=["cost", "audit", "at", "roles"])

    return run(symbols)


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost``: rows damaged by the checksum of ``conv_id:turn``.

    Of twenty remainders 0 loses the row (it stays with ``lost``, so that its conversation is known), 1 empties its text, 2
    removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    def named(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    hit = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    role = F.when(hit == 4, "user").otherwise(named("role"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("_hit"))
    copies = F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("*", F.explode(copies).alias("_copy")).select("conv_id", "turn", "role", "text", (F.col("_hit") == 0).alias("lost"))


def repaired(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, turns``: one row per conversation.

    Takes ``conv_id, turn, role, text`` and, if there, ``lost`` (the row does not count, its conversation is still reported);
    other columns are ignored. Rows are ordered by turn, role and text, nulls first; a null conv_id is a conversation of its
    own, null roles and texts are one space, and a role that is empty or begins with another letter than s, u or a cannot stay as it is.
    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. ``audit`` names the edits in order: Keep,
    Rerole, Delete, Insert. ``turns`` is the repaired conversation, an array of ``role, text``; without rows it is empty.

    The rows are dealt once, by conversation, and meet in one row, as audit and repaired turns demand.
    """
    lost = F.coalesce(F.col("lost"), F.lit(False)) if "lost" in turns.columns else F.lit(False)
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), lost.alias("lost")).repartition("conv_id")
    of = Window.partitionBy("conv_id", "lost").orderBy("turn", "role", "text")
    alike = Window.partitionBy("conv_id", "lost", "role", "text").orderBy("n")
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    blank = ~F.col("text").rlike(f"[^{LOOK}]")
    fault = (F.when(blank, "blank").when(F.col("_seen") > 1, "duplicate")
             .when(F.col("text").rlike(rf"[^.!?{LOOK}][{LOOK}]*+\z"), "truncated"))
    rows = rows.withColumn("initial", initial)
    rows = rows.select(
        "*", F.row_number().over(of).alias("n"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(of))).alias("new_turn"),
        F.concat(F.lag("initial").over(of), "initial").alias("pair"))
    rows = rows.withColumn("_seen", F.row_number().over(alike)).withColumn("fault", fault)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    here = ~F.col("lost")

    def count(condition: Column) -> Column:
        return F.coalesce(F.count_if(here & condition), F.lit(0)).cast("long")

    turn = F.when(here, F.col("turn"))
    chats = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - count(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        count(F.col("fault") == "blank").alias("blank"), count(F.col("fault") == "duplicate").alias("duplicate"),
        count(F.col("fault") == "truncated").alias("truncated"), count(~F.col("pair").isin("su", "ua", "au")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(here, F.struct("n", "role", "text", symbol.alias("symbol"))))).alias("rows"))
    chats = chats.withColumn("best", parsed(F.array_join(F.col("rows.symbol"), "")))

    def turn_of(pick: Column) -> Column:
        row = F.get("rows", pick["at"] - 1)
        return F.struct(F.when(pick["roles"] == "", row["role"]).otherwise(pick["roles"]).alias("role"),
                        F.when(pick["at"] == 0, "").otherwise(row["text"]).alias("text"))

    turns_of = F.transform(F.arrays_zip(F.col("best.at").alias("at"), F.col("best.roles").alias("roles")), turn_of)
    return chats.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal",
                        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), turns_of.alias("turns"))
