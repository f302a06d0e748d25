"""Records that arrive in windows: a count window sees its own records only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linkwright.operators import decide as H
from linkwright.operators import evaluate as I
from linkwright.operators.order import numbered
from linkwright.sources.tables import LEFT, RIGHT

WINDOWS = (1, 10, 25, 100, 250, 500, 1000, 2554)


def arrival(scores: DataFrame) -> DataFrame:
    """(left, nth) of distinct left ids in string order, from 0."""
    return numbered(scores.select(LEFT).distinct(), [LEFT])


def windowed(scores: DataFrame, size: int) -> DataFrame:
    """scores with the number of the arrival window of each left record."""
    place = arrival(scores).withColumn("window", F.floor(F.col("nth") / size)).drop("nth")
    return scores.join(place, LEFT)


def windowed_reciprocity(scores: DataFrame, decided: DataFrame, size: int) -> DataFrame:
    """The reciprocity veto where only records of one window compete; a window of one vetoes nothing."""
    if size <= 1:
        return decided
    return H.reciprocity_veto(decided, H.reciprocal_best(windowed(scores, size), by=["window"]))


def window_curve(scores: DataFrame, decided: DataFrame, truth: DataFrame, sizes: tuple[int, ...] = WINDOWS) -> DataFrame:
    """size, accepted, precision, recall, F1 (percent, two places) and the difference from the largest window."""
    rows = None
    for size in sizes:
        chosen = H.accepted(windowed_reciprocity(scores, decided, size))
        e = I.evaluate_pairs(chosen, truth).select(F.lit(size).alias("size"), (F.col("tp") + F.col("fp")).alias("accepted"), *[F.round(100 * F.col(c), 2).alias(c) for c in ("precision", "recall", "f1")])
        rows = e if rows is None else rows.unionByName(e)
    top = rows.agg(F.max_by("f1", "size").alias("top"))
    return rows.crossJoin(top).withColumn("difference", F.round(F.col("f1") - F.col("top"), 2)).drop("top")


def stream_decisions(scores: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Structured Streaming form: every micro-batch of scored pairs is a window, decided by itself and never taken back.

    A batch is decided from its own rows only, so replays after a failure give the same rows for the same batch number.
    """

    def decide(batch: DataFrame, number: int) -> None:
        one = batch.select(LEFT, RIGHT, "bits").persist()
        sink(H.accepted(H.reciprocity_veto(H.outcomes(one), H.reciprocal_best(one))), number)
        one.unpersist()

    return scores.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Count windows in a stream

ARRIVAL = f"nth long, {LEFT} string, candidates array<struct<{RIGHT}: string, bits: double>>, last boolean"
_CANDIDATES = f"candidates array<struct<{RIGHT}: string, bits: double>>"
_DECIDED = f"window long, {LEFT} string, best_candidate string, best_bits double, outcome string"


def arrivals(scores: DataFrame) -> DataFrame:
    """One row for each left record in order of arrival: its number, its candidates, and whether it is the last one."""
    lists = scores.groupBy(LEFT).agg(F.sort_array(F.collect_list(F.struct(RIGHT, "bits"))).alias("candidates"))
    total = scores.agg(F.count_distinct(LEFT).alias("total"))
    return lists.join(arrival(scores), LEFT).crossJoin(total).select(F.col("nth").cast("long").alias("nth"), LEFT, "candidates", (F.col("nth") == F.col("total") - 1).alias("last"))


def decide_window(held: dict[str, list[tuple[str, float]]], alone: bool, accept: float, margin: float, floor: float) -> list[tuple[str, str, float, str]]:
    """(left, best candidate, bits, outcome) of the records of one window, of which none sees another window's.

    A record without candidates has no outcome. Where ``alone`` (windows of one), reciprocity vetoes nothing.
    """
    tops: dict[str, float] = {}
    for found in held.values():
        for right, bits in found:
            tops[right] = max(bits, tops.get(right, float("-inf")))
    at_top: dict[str, int] = {}
    for found in held.values():
        for right, bits in found:
            at_top[right] = at_top.get(right, 0) + (bits == tops[right])
    out = []
    for left in sorted(held):
        order = sorted(held[left], key=lambda x: (-x[1], x[0]))
        if not order:
            continue
        right, bits = order[0]
        ahead = bits - order[1][1] if len(order) > 1 else float("inf")
        outcome = (H.ACCEPT if ahead > margin else H.TIED) if bits >= accept else H.UNSURE if bits >= floor else H.DIFFERENT
        if outcome == H.ACCEPT and not alone and not (bits == tops[right] and at_top[right] == 1):
            outcome = H.NOT_RECIPROCAL
        out.append((left, right, bits, outcome))
    return out


class CountWindow(StatefulProcessor):
    """Holds the arrivals of one window until there are ``size`` of them, or the stream's last one and all before it; then decides and forgets them."""

    def __init__(self, size: int, accept: float, margin: float, floor: float):
        self.size, self.rules = size, (accept, margin, floor)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", f"{LEFT} string", _CANDIDATES)
        self.due = handle.getValueState("due", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = self.due.get()[0] if self.due.exists() else self.size
        if due == 0:  # decided: what comes again has been seen
            return
        for t in rows:
            for r in t.itertuples(index=False):
                self.held.updateValue((getattr(r, LEFT),), ([(c[RIGHT], float(c["bits"])) for c in r.candidates],))
                if r.last:
                    due = min(due, int(r.nth) - int(key[0]) * self.size + 1)
        held = {k[0]: [(c[0], c[1]) for c in v[0]] for k, v in self.held.iterator()}
        if len(held) < due:
            self.due.update((due,))
            return
        self.held.clear()
        self.due.update((0,))
        yield pd.DataFrame([(int(key[0]), *x) for x in decide_window(held, self.size <= 1, *self.rules)], columns=["window", LEFT, "best_candidate", "best_bits", "outcome"])

    def close(self) -> None:
        pass


def stream_windows(arriving: DataFrame, size: int, accept: float = H.ACCEPT_BITS, margin: float = H.MARGIN_BITS, floor: float = H.FLOOR_BITS) -> DataFrame:
    """Decisions of a stream of arrivals (ARRIVAL) in tumbling windows of ``size`` records, whatever the micro-batches.

    A window is decided once, when its last record is there; arrivals may come late, in any order, and more than once. The
    windows are keys of the state, so that they spread over tasks; a window's state is its own records and goes with it.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). The outcomes are those of windowed_reciprocity().
    """
    keyed = arriving.withColumn("window", F.floor(F.col("nth") / size).cast("long"))
    return keyed.groupBy("window").transformWithStateInPandas(CountWindow(size, accept, margin, floor), outputStructType=_DECIDED, outputMode="Append", timeMode="None")
