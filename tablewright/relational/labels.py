"""Training tables: entity, as-of time, label and an out-of-time split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.plans.guard import QueryWorkspace
from tablewright.relational.spec import RelationalError, TaskSpec

SPLITS = ("train", "val", "test")
AMOUNT = "decimal(38,6)"  # sums come out the same in any order


def grid_dates(start: str, end: str, months: int) -> Column:
    """The as-of dates as an array literal."""
    return F.sequence(
        F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_ym_interval(F.lit(0), F.lit(months))
    )


def time_grid(
    entities: DataFrame, entity: str, eligible_from: Column, start: str, end: str, months: int
) -> DataFrame:
    """Every entity at every grid date from ``eligible_from`` on.

    The dates are generated inside each entity's row, so nothing is joined.
    """
    dates = F.filter(grid_dates(start, end, months), lambda d: d >= F.col("_from"))
    return (
        entities.withColumn("_from", eligible_from)
        .select(F.col(entity), F.explode(dates).alias("as_of"))
    )


def attribute_label(df: DataFrame, entity: str, as_of: Column, positive: Column) -> DataFrame:
    """The outcome is written on the entity's own row."""
    return df.select(F.col(entity), as_of.alias("as_of"), F.when(positive, 1).otherwise(0).alias("label"))


def future_event_label(
    grid: DataFrame, entity: str, events: DataFrame, event_entity: str, event_time: str, horizon_days: int
) -> DataFrame:
    """Will the first event come within the horizon?  Entities that had one are out.

    "No event up to as-of" and "an event within the horizon" both follow from
    the entity's first event, so one small grouping replaces two range joins.
    """
    first = events.groupBy(F.col(event_entity).alias("_entity")).agg(F.min(event_time).alias("_first"))
    known = grid.join(first, grid[entity] == first["_entity"], "left")
    ahead = known.filter(F.col("_first").isNull() | (F.col("_first") > F.col("as_of")))
    soon = F.col("_first") <= F.col("as_of") + F.expr(f"INTERVAL '{int(horizon_days)}' DAY")
    return ahead.select(entity, "as_of", F.when(soon, 1).otherwise(0).alias("label"))


def volume_around(
    events: DataFrame,
    event_entity: str,
    event_time: str,
    amount: str,
    start: str,
    end: str,
    months: int,
    before_days: int,
    after_days: int,
) -> DataFrame:
    """Volume in the days before and after each grid date, per entity.

    Each event is sent to the few grid dates it can count for and summed on
    the map side; an entity with a third of all events arrives as one row per
    grid date and task.
    """
    at = F.col(event_time)
    near = F.filter(
        grid_dates(start, end, months),
        lambda g: (at > F.date_sub(g, before_days)) & (at <= F.date_add(g, after_days)),
    )
    placed = events.select(
        F.col(event_entity).alias("entity"), at.alias("at"), F.col(amount).cast(AMOUNT).alias("amount"),
        F.explode(near).alias("as_of"),
    )
    zero = F.lit(0).cast(AMOUNT)
    return placed.groupBy("entity", "as_of").agg(
        F.coalesce(F.sum(F.when(F.col("at") <= F.col("as_of"), F.col("amount"))), zero).alias("before"),
        F.coalesce(F.sum(F.when(F.col("at") > F.col("as_of"), F.col("amount"))), zero).alias("after"),
    )


def volume_drop_label(grid: DataFrame, entity: str, volumes: DataFrame, share: float = 0.5) -> DataFrame:
    """1 if the volume ahead falls below ``share`` of the volume behind, which must be positive."""
    active = volumes.filter(F.col("before") > 0).withColumnRenamed("entity", entity)
    drop = F.col("after") < F.lit(share).cast("decimal(10,4)") * F.col("before")
    return grid.join(active, [entity, "as_of"]).select(entity, "as_of", F.when(drop, 1).otherwise(0).alias("label"))


def query_label(workspace: QueryWorkspace, task: TaskSpec) -> DataFrame:
    """A guarded label query; it must return the entity id, ``as_of`` and ``label``."""
    df = workspace.select(task.label_query)
    missing = [c for c in (task.entity_column, "as_of", "label") if c not in df.columns]
    if missing:
        raise RelationalError(f"task '{task.name}': the label query does not return {', '.join(missing)}")
    return df.select(task.entity_column, "as_of", "label")


def assign_splits(df: DataFrame, val_cutoff: str, test_cutoff: str) -> DataFrame:
    at = F.col("as_of").cast("timestamp_ntz")
    cut = lambda text: F.lit(text).cast("timestamp_ntz")
    split = F.when(at >= cut(test_cutoff), "test").when(at >= cut(val_cutoff), "val").otherwise("train")
    return df.withColumn("split", split)


def split_report(table: DataFrame) -> DataFrame:
    """Rows and positives per split."""
    return table.groupBy("split").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
        F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(True))).alias("invalid"),
    )


def validate_training_table(task_name: str, table: DataFrame) -> dict[str, dict[str, int]]:
    """Raise if a split is empty or one-sided; return its sizes otherwise."""
    found = {r["split"]: r.asDict() for r in split_report(table).collect()}  # three rows at most
    if not found:
        raise RelationalError(f"task '{task_name}': the training table is empty")
    for name in SPLITS:
        if name not in found:
            raise RelationalError(f"task '{task_name}': split '{name}' is empty")
        if any(part["invalid"] for part in found.values()):
            raise RelationalError(f"task '{task_name}': labels must be 0 or 1")
        if not found[name]["positive"] or not found[name]["negative"]:
            raise RelationalError(f"task '{task_name}': split '{name}' contains only one label class")
    return found
