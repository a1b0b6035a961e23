"""State machines over event logs: every event gets its verdict, also where one item holds most events.

A machine is a table of (state, action) -> (state after, verdict).  ``applied`` writes a revision, ``no_op`` repeats what is so
already, ``forbidden`` changes nothing and is reported as a row.  The batch fold does not walk an item's events one after
the other: an event is a function from states to states, so a piece of ``PIECE`` events is one such function, a small
array.  Pieces are folded apart, their functions are chained item by item to find the state each piece starts in, and the
events of a piece then get their states.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.operators.ranking import numbered
from pricelode.shared import written

PIECE = 128
APPLIED, NO_OP, FORBIDDEN = "applied", "no_op", "forbidden"


@dataclass(frozen=True)
class Machine:
    """``states`` with the initial one first, ``actions``, and the moves; a pair without a move is forbidden and stays."""

    states: tuple[str, ...]
    actions: tuple[str, ...]
    moves: dict[tuple[str, str], tuple[str, str]]

    def move(self, state: str, action: str | None) -> tuple[str, str]:
        return self.moves.get((state, action), (state, FORBIDDEN))

    def table(self) -> list[tuple[int, str]]:
        """Number of the state after and verdict for each state and action in order; unknown actions come last."""
        every = [self.move(s, a) for s in self.states for a in (*self.actions, None)]
        return [(self.states.index(s), v) for s, v in every]

    def code(self, action: Column) -> Column:
        """Number of an action; of any other text or null the one after the last."""
        at = F.array_position(F.array(*map(F.lit, self.actions)), action).cast("int")
        return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(self.actions)))


def _open_moves() -> dict[tuple[str, str], tuple[str, str]]:
    open_states = ("pending", "draft", "needs_followup")
    moves = {("none", "seed"): ("pending", APPLIED)}
    for s in open_states:
        moves |= {(s, "draft"): ("draft", APPLIED), (s, "needs_followup"): ("needs_followup", APPLIED), (s, "approve"): ("approved", APPLIED), (s, "reject"): ("rejected", APPLIED)}
    moves |= {(s, "reopen"): ("pending", APPLIED) for s in ("rejected", "draft", "needs_followup")}
    moves |= {(s, "seed"): (s, NO_OP) for s in (*open_states, "approved", "rejected")}
    return moves | {("approved", "approve"): ("approved", NO_OP), ("rejected", "reject"): ("rejected", NO_OP), ("pending", "reopen"): ("pending", NO_OP)}


#: Review of an item: drafts and follow-ups while open; approval is final; a rejected item can be reopened.
REVIEW = Machine(("none", "pending", "draft", "needs_followup", "approved", "rejected"), ("seed", "draft", "needs_followup", "approve", "reject", "reopen"), _open_moves())


def folded(events: DataFrame, machine: Machine, item: str, order: Sequence[Column], action: Column) -> DataFrame:
    """``events`` with from_state, to_state, verdict and revision (of the item after the event, from 1; 0 while it has none).

    ``order`` must tell events of an item apart.  Null actions and unknown ones are forbidden."""
    width = len(machine.actions) + 1
    after = F.array(*(F.lit(s) for s, _ in machine.table()))
    verdicts = F.array(*(F.lit(v) for _, v in machine.table()))
    at = lambda state, code: (state * width + code + 1).cast("int")
    own = events.columns
    rows = numbered(events.withColumn("_code", machine.code(action)), "_place", list(order), [item])
    pieces = rows.withColumn("_piece", F.floor((F.col("_place") - 1) / PIECE)).groupBy(F.col(item).alias("_item"), "_piece")
    pieces = written(pieces.agg(F.sort_array(F.collect_list(F.struct("_place", "_code", F.struct(*own).alias("_row")))).alias("_ev")), "pieces")
    step = lambda state, e: F.element_at(after, at(state, e["_code"]))
    ends = F.transform(F.array(*(F.lit(i) for i in range(len(machine.states)))), lambda s: F.aggregate("_ev", s, step))
    chained = pieces.select("_item", "_piece", ends.alias("ends")).groupBy("_item").agg(F.sort_array(F.collect_list(F.struct("_piece", "ends"))).alias("p"))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("all"))
    walked = F.aggregate("p", start, lambda acc, p: F.struct(F.element_at(p["ends"], acc["s"] + 1).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all")))["all"]
    starts = chained.select(F.col("_item").alias("_of"), F.explode(F.arrays_zip(F.col("p._piece").alias("piece"), walked.alias("state"))).alias("x")).select("_of", F.col("x.piece").alias("_of_piece"), F.col("x.state").alias("_start"))
    joined = pieces.join(starts, F.col("_item").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_of_piece")))
    first = F.struct(F.col("_start").alias("s"), F.array().cast("array<int>").alias("all"))
    states = F.aggregate("_ev", first, lambda acc, e: F.struct(step(acc["s"], e).alias("s"), F.concat(acc["all"], F.array(acc["s"])).alias("all")))["all"]
    each = joined.select("_item", "_piece", F.explode(F.arrays_zip(F.col("_ev").alias("e"), states.alias("s"))).alias("x")).select("_item", "_piece", F.col("x.e._place").alias("_place"), F.col("x.s").alias("_s"), F.col("x.e._code").alias("_code"), "x.e._row.*")
    names = F.array(*map(F.lit, machine.states))
    each = written(each.withColumns({"from_state": F.element_at(names, F.col("_s") + 1), "to_state": F.element_at(names, F.element_at(after, at(F.col("_s"), F.col("_code"))) + 1), "verdict": F.element_at(verdicts, at(F.col("_s"), F.col("_code")))}), "verdicts")
    applied = (F.col("verdict") == APPLIED).cast("long")
    before = each.groupBy(F.col("_item").alias("_of"), F.col("_piece").alias("_of_piece")).agg(F.sum(applied).alias("_n"))
    so_far = Window.partitionBy("_of").orderBy("_of_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    before = before.select("_of", "_of_piece", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    counted = each.join(before, F.col("_item").eqNullSafe(F.col("_of")) & (F.col("_piece") == F.col("_of_piece")))
    inside = F.sum(applied).over(Window.partitionBy("_item", "_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return counted.withColumn("revision", F.col("_before") + inside).select(*own, "from_state", "to_state", "verdict", "revision")
