"""Order and placement of jobs by cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lectern.operators.ordered import numbered, position_bucket


#: Costs at which the order of all jobs is cut, at equal shares of them.
CUTS = 64


def _cost_bucket(jobs: DataFrame, cost: str, task: str) -> Column:
    """Where a job is in the order by falling cost, then task: between which cuts, or on one, and then among which tasks."""
    shares = [i / CUTS for i in range(CUTS + 1)]
    cuts = jobs.agg(F.percentile_approx(F.col(cost).cast("double"), shares, 10_000).alias("c")).first().c or []
    cuts, value = F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), F.col(cost).cast("double")
    higher, on = F.size(F.filter(cuts, lambda c: c > value)), F.array_contains(cuts, value)
    tasks = position_bucket(F.col(task)) if isinstance(jobs.schema[task].dataType, NumericType) else F.lit(0).cast("long")
    place = F.when(value.isNull(), 2 * CUTS + 3).otherwise(2 * higher - F.when(on, 0).otherwise(1))
    return F.struct(place.alias("cost"), F.when(on, tasks).otherwise(F.lit(0).cast("long")).alias("task"))


def longest_first(jobs: DataFrame, run: str, cost: str, task: str) -> DataFrame:
    """``jobs`` with ``rank``: most costly first, ties by task.

    Ranks are counted between sampled cuts of the costs and added up, so a run of any size is spread over many tasks; a cost that
    many jobs have is a cut, and cut again by task.
    """
    return numbered(jobs, [run], _cost_bucket(jobs, cost, task), [F.col(cost).desc(), F.col(task)], "rank")


def snake_slots(jobs: DataFrame, run: str, cost: str, task: str, slots: int) -> DataFrame:
    """Ranked jobs dealt to slots back and forth, so that each slot gets costs of every size."""
    lap = (F.col("rank") - 1) % (2 * slots)
    return longest_first(jobs, run, cost, task).withColumn("slot", F.when(lap < slots, lap).otherwise(2 * slots - 1 - lap).cast("int"))


def greedy_slots(jobs: DataFrame, run: str, cost: str, task: str, slots: int) -> DataFrame:
    """(run, task, slot): ranked jobs each to the least loaded slot, the first of equal ones."""
    ordered = jobs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct((-F.col(cost)).alias("less"), F.col(task).alias("task")))).alias("all"))
    loads = F.array(*[F.lit(0.0)] * slots)
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<task:bigint,slot:int>>)").alias("placed"))

    def step(a, j):
        slot = F.array_position(a["loads"], F.array_min(a["loads"])).cast("int") - 1
        filled = F.transform(a["loads"], lambda load, i: F.when(i == slot, load - j["less"]).otherwise(load))
        return F.struct(filled.alias("loads"), F.array_append(a["placed"], F.struct(j["task"].alias("task"), slot.alias("slot"))).alias("placed"))

    return ordered.select(run, F.explode(F.aggregate("all", start, step, lambda a: a["placed"])).alias("p")).select(run, F.col("p.task").alias(task), "p.slot")


def makespan(placed: DataFrame, run: str, cost: str, slots: int) -> DataFrame:
    """(run, longest, mean): the largest load of a slot, and the load if all were equal."""
    loads = placed.groupBy(run, "slot").agg(F.sum(cost).alias("load"))
    return loads.groupBy(run).agg(F.round(F.max("load"), 6).alias("longest"), F.round(F.sum("load") / slots, 6).alias("mean"))
