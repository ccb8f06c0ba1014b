"""Feature matrices: a registry of named column factories, down-sampling onto grids, interpolation and pivoting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoframe.operators.temporal import ordered

Factory = Callable[[], list[tuple[str, Column]]]


class Registry:
    """Name -> the columns it adds. An unknown name is an error that lists the known ones."""

    def __init__(self) -> None:
        self.factories: dict[str, Factory] = {}

    def feature(self, name: str) -> Callable[[Factory], Factory]:
        def put(factory: Factory) -> Factory:
            if name in self.factories:
                raise ValueError(f"feature {name!r} is registered already")
            self.factories[name] = factory
            return factory

        return put

    def columns(self, names: list[str]) -> list[tuple[str, Column]]:
        unknown = [n for n in names if n not in self.factories]
        if unknown:
            raise KeyError(f"unknown features {unknown}; known: {sorted(self.factories)}")
        return [c for n in names for c in self.factories[n]()]

    def select(self, df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
        return df.select(*keep, *(c.alias(n) for n, c in self.columns(names)))

    def headers(self, names: list[str], members: list[str] | None = None) -> list[str]:
        own = [n for n, _ in self.columns(names)]
        return own if members is None else [f"{m}_{n}" for m in members for n in own]


def on_grid(df: DataFrame, keys: list[str], order: list[str], clock: str, step: int) -> DataFrame:
    """Samples the entity's series every ``step`` from its first sample on: grid points are served by the first sample at or after them, so
    that a sample serves as many points as lie between it and the one before."""
    w = ordered(keys, order)
    first = F.min(clock).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.floor((F.col(clock) - F.col("__first")) / step)
    staged = df.withColumn("__first", first).withColumn("__number", number)
    staged = staged.withColumn("__before", F.coalesce(F.lag("__number").over(w), F.lit(-1)))
    points = staged.where("__number > __before").withColumn("point", F.explode(F.sequence(F.col("__before") + 1, F.col("__number"))))
    return points.withColumn("grid", F.col("__first") + F.col("point") * step).drop("__first", "__number", "__before")


def one_per_step(df: DataFrame, keys: list[str], order: list[str], clock: str, step: int) -> DataFrame:
    """The first sample of each step since the entity's first one, and its last sample in any case."""
    w = ordered(keys, order)
    first = F.min(clock).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    staged = df.withColumn("__n", F.floor((F.col(clock) - first) / step))
    staged = staged.withColumn("__before", F.lag("__n").over(w)).withColumn("__next", F.lead(clock).over(w))
    return staged.where(F.col("__before").isNull() | (F.col("__n") > F.col("__before")) | F.col("__next").isNull()).drop("__n", "__before", "__next")


def interpolated(df: DataFrame, keys: list[str], order: list[str], clock: str, value: Column, name: str) -> DataFrame:
    """Fills the value at samples where it is null: linear in time between the known samples around; null outside of them."""
    w = ordered(keys, order)
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = F.when(F.col("__v").isNotNull(), F.struct(F.col(clock).alias("t"), F.col("__v").alias("v")))
    staged = df.withColumn("__v", value).withColumn("__a", F.last(known, ignorenulls=True).over(before)).withColumn("__b", F.first(known, ignorenulls=True).over(after))
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * ((F.col(clock) - a["t"]) / (b["t"] - a["t"]))
    filled = F.when(F.col("__v").isNotNull(), F.col("__v").cast("double")).when(b["t"] > a["t"], between).when(a["t"] == b["t"], a["v"].cast("double"))
    return staged.withColumn(name, filled).drop("__v", "__a", "__b")


def wide(df: DataFrame, index: list[str], member: str, members: list, values: list[str]) -> DataFrame:
    """One row per index with <member>_<value> columns, the members in the given order; 0 where a member has no row. The list of members is
    given, so no pass over the data is spent on finding it."""
    cells = [F.coalesce(F.max(F.when(F.col(member) == m, F.col(v))), F.lit(0)).alias(f"{m}_{v}") for m in members for v in values]
    return df.groupBy(*index).agg(*cells)
