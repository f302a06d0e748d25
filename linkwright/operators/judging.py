"""A run of model judgements under a budget: each item in several orders and once more as a control, in waves, with a ledger that survives a crash.

A wave is reserved in the ledger before its calls are made and is not chosen again: a run that was killed repeats the
wave that it had reserved, no other, and replaces what that wave had written. So the ledger ends up the same, however often
the run was killed. What a wave may cost at worst must fit into what is left before any call of it is made, in whatever task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.operators import review as L
from linkwright.operators.decide import shuffle_key
from linkwright.sources.tables import LEFT, RIGHT

RUNS = 3
COMPLETE, BUDGET, CALLS, FAILURES = "complete", "budget", "calls", "failures"
_TASKS = "seq long, item string, run int, control boolean, prompt string, reserve double, wave int"
_LEDGER = "seq long, item string, run int, control boolean, reply string, cost double, failed string, wave int"
#: A prompt to (reply, cost).
Judge = Callable[[str], tuple[str, float]]


def shown_in_order(items: DataFrame, run: int, salt: str = "") -> DataFrame:
    """Items with the members of every block in the order of one run; nothing else changes."""
    key = lambda b, m: shuffle_key(f"{salt}#{run}", F.col(LEFT), m[RIGHT])

    def block(b):
        keyed = F.array_sort(F.transform(b["members"], lambda m: F.struct(key(b, m).alias("k"), m.alias("m"))))
        return b.withField("members", F.transform(keyed, lambda x: x["m"]))

    return items.withColumn("candidate_blocks", F.transform("candidate_blocks", block))


def tasks(items: DataFrame, fields: list[str], price: Callable, runs: int = RUNS, salt: str = "") -> DataFrame:
    """(item, run, control, prompt, reserve) of every call: each item in ``runs`` orders, and the first order again as a control.

    price gives the most that a call may cost, as a Column expression of its prompt.
    """
    out = None
    for run in range(runs + 1):
        control = run == runs
        shown = L.render_prompt(shown_in_order(items, 0 if control else run, salt), fields)
        rows = shown.select(F.col(LEFT).alias("item"), F.lit(run).alias("run"), F.lit(control).alias("control"), "prompt", price(F.col("prompt")).cast("double").alias("reserve"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _there(spark: SparkSession, path: str) -> set[int]:
    """Waves of a part of the ledger that were written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return set()
    names = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("wave-")]
    return {int(p.getName().split("-")[1]) for p in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    there = _there(spark, path)
    return spark.read.schema(schema).json([f"{path}/wave-{w}" for w in sorted(there)]) if there else spark.createDataFrame([], schema)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All calls that were made: seq, item, run, control, reply, cost, failed (the error), wave."""
    return _read(spark, f"{path}/calls", _LEDGER)


@dataclass
class Report:
    reason: str
    waves: int
    calls: int
    failed: int
    spent: float


def run(planned: DataFrame, judge: Judge, path: str, limit: float, wave: int = 256, most_calls: int | None = None, most_failures: int = 50, parallel: int = 8) -> Report:
    """Make the planned calls (tasks()) in the order of their seq until all are made or a reason to stop appears; go on where an earlier run ended.

    The order is by a hash of item and run, so that every part of a run is a fair sample. reason: complete; budget, where the
    worst cost of the next call doesn't fit into what is left; calls, at most_calls; failures, where more calls have failed
    than most_failures. A failed call has no reply and costs its reserve; it isn't made again.
    """
    spark = planned.sparkSession
    order = F.xxhash64("item", "run").alias("seq")
    numbered = planned.select(order, "item", "run", "control", "prompt", "reserve")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            rows = []
            for r in t.to_dict("records"):
                try:
                    reply, cost, failed = *judge(r["prompt"]), None
                except Exception as e:  # noqa: BLE001  whatever the service raises is in the ledger
                    reply, cost, failed = None, r["reserve"], f"{type(e).__name__}: {e}"
                rows.append((r["seq"], r["item"], r["run"], r["control"], reply, float(cost), failed, r["wave"]))
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _LEDGER.split(", ")])

    while True:
        reserved, made = _there(spark, f"{path}/reserved"), _there(spark, f"{path}/calls")
        open_waves = sorted(reserved - made)
        done = ledger(spark, path)
        total = done.agg(F.count("*").alias("n"), F.count("failed").alias("failed"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent")).first()
        report = lambda reason: Report(reason, len(made), total["n"], total["failed"], round(total["spent"], 9))  # noqa: B023, E731
        if open_waves:
            number = open_waves[0]
        else:
            if total["failed"] > most_failures:
                return report(FAILURES)
            room = wave if most_calls is None else min(wave, most_calls - total["n"])
            if room <= 0:
                return report(CALLS)
            # As many rows as a wave reach the driver; they are cut where the budget ends.
            nexts = numbered.join(done.select("item", "run"), ["item", "run"], "left_anti").orderBy("seq", "item", "run").limit(room).collect()
            if not nexts:
                return report(COMPLETE)
            chosen, left = [], limit - total["spent"]
            number = max(reserved, default=-1) + 1
            for r in nexts:
                if r["reserve"] > left + 1e-9:
                    break
                left -= r["reserve"]
                chosen.append((r["seq"], r["item"], r["run"], r["control"], r["prompt"], r["reserve"], number))
            if not chosen:
                return report(BUDGET)
            spark.createDataFrame(chosen, _TASKS).coalesce(1).write.mode("overwrite").json(f"{path}/reserved/wave-{number}")
        todo = spark.read.schema(_TASKS).json(f"{path}/reserved/wave-{number}")
        todo.repartition(parallel, "seq").mapInPandas(call, _LEDGER).write.mode("overwrite").json(f"{path}/calls/wave-{number}")


def verdicts(calls: DataFrame) -> DataFrame:
    """The majority decision of each item over its orders (ties to the earliest), from usable replies: item, answer, votes."""
    parsed = L.parsed_replies(calls.filter(~F.col("control")), "reply").filter("problem is null")
    answers = parsed.withColumn("answer", F.when(F.col("decision") == "match", F.concat(F.lit("match:"), "id")).otherwise(F.col("decision")))
    return L.majority(answers, "item", "run", "answer")


def steadiness(calls: DataFrame, options: DataFrame, runs: int = RUNS) -> DataFrame:
    """stability() of a run's ledger; options (item, k): how many answers an item allowed. A reply that can't be used is no answer."""
    parsed = L.parsed_replies(calls, "reply")
    answer = F.when(F.col("problem").isNull(), F.when(F.col("decision") == "match", F.concat(F.lit("match:"), "id")).otherwise(F.col("decision")))
    votes = parsed.withColumn("answer", answer).join(options, "item").select("item", "run", "control", "answer", "k")
    return L.stability(votes, "item", "answer", "k", "control", runs)
