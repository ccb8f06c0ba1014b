"""Joins in time: as-of, interval, band and nearest matches, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], clock: str, tie: str, columns: list[str], staleness: int | None = None) -> DataFrame:
    """Each left row with the columns (as last_<column>) of the key's latest right row strictly before it in (clock, tie); null if there is
    none, or if it is older than staleness. Both sides are put in one order, and a window carries the last right row on: one shuffle, no join."""
    marked = left.withColumn("__row", F.struct(*left.columns)).select(*keys, F.col(clock).alias("__t"), F.col(tie).alias("__tie"), F.lit(1).alias("__side"), "__row", F.lit(None).alias("__value"))
    value = F.struct(F.col(clock).alias("__at"), *columns)
    other = right.select(*keys, F.col(clock).alias("__t"), F.col(tie).alias("__tie"), F.lit(0).alias("__side"), F.lit(None).alias("__row"), value.alias("__value"))
    # At equal (clock, tie) the left row comes first, so that it does not see its own right row.
    w = Window.partitionBy(*keys).orderBy("__t", "__tie", F.desc("__side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = marked.unionByName(other).withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    fresh = F.lit(True) if staleness is None else F.col("__t") - F.col("__last.__at") <= staleness
    return carried.select("__row.*", *(F.when(fresh, F.col(f"__last.{c}")).alias(f"last_{c}") for c in columns))


def in_window(left: DataFrame, right: DataFrame, keys: list[str], clock: str, right_clock: str, first: int, last: int) -> DataFrame:
    """All pairs of a key with right_clock - clock between first and last (0 <= first), by an equi-join on time cells of that
    width: a left row meets its own cell and the next."""
    size = max(1, last)
    cell = F.floor(F.col(clock) / size)
    cells = left.withColumn("__cell", F.explode(F.array(cell, cell + 1)))
    placed = right.withColumn("__cell", F.floor(F.col(right_clock) / size))
    gap = F.col(right_clock) - F.col(clock)
    return cells.join(placed, [*keys, "__cell"]).where((gap >= first) & (gap <= last)).drop("__cell")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], clock: str, tie: str, width: int, columns: list[str]) -> DataFrame:
    """Each left row that has a right row up to ``width`` before it (not at the same moment), with the latest one's columns."""
    early = right.select(*keys, F.col(clock).alias("__early"), F.col(tie).alias("__early_tie"), *(F.col(c).alias(f"match_{c}") for c in columns))
    pairs = in_window(early, left, keys, "__early", clock, 1, width)
    w = Window.partitionBy(*(left[c] for c in keys), tie).orderBy(F.desc("__early"), F.desc("__early_tie"))
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__early", "__early_tie")


def unbroken(pairs: DataFrame, breaks: DataFrame, keys: list[str], start: str, end: str, clock: str) -> DataFrame:
    """The pairs without a break of their key strictly between start and end. Breaks are counted up to each end of a pair by as-of windows."""
    marks = breaks.select(*keys, F.col(clock).alias("__t"), F.lit(1).alias("__b"), F.lit(0).alias("__what"), F.lit(None).alias("__id"))
    numbered = pairs.withColumn("__id", F.struct(*pairs.columns))
    begins = numbered.select(*keys, F.col(start).alias("__t"), F.lit(0).alias("__b"), F.lit(1).alias("__what"), "__id")
    ends = numbered.select(*keys, F.col(end).alias("__t"), F.lit(0).alias("__b"), F.lit(2).alias("__what"), "__id")
    # Up to and including the start, and up to but not including the end.
    incl = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    excl = Window.partitionBy(*keys).orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    counted = marks.unionByName(begins).unionByName(ends).select("*", F.sum("__b").over(incl).alias("__incl"), F.coalesce(F.sum("__b").over(excl), F.lit(0)).alias("__excl"))
    clear = counted.where("__what > 0").groupBy("__id").agg(F.max(F.when(F.col("__what") == 1, F.col("__incl"))).alias("a"), F.max(F.when(F.col("__what") == 2, F.col("__excl"))).alias("b")).where("b <= a").select("__id")
    return numbered.join(clear, "__id", "left_semi").drop("__id")


def pairs_within(df: DataFrame, keys: list[str], id_: str, clock: str, width: int) -> DataFrame:
    """Pairs (a_<id>, b_<id>) of one key, a before b in (clock, id), at most ``width`` apart. width bounds what a row can meet."""
    left = df.select(*keys, F.col(id_).alias(f"a_{id_}"), F.col(clock).alias("a_clock"))
    right = df.select(*keys, F.col(id_).alias(f"b_{id_}"), F.col(clock).alias("b_clock"))
    found = in_window(left, right, keys, "a_clock", "b_clock", 0, width)
    return found.where((F.col("b_clock") > F.col("a_clock")) | (F.col(f"b_{id_}") > F.col(f"a_{id_}")))


def flag_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a 0/1 column: whether other has a row with these keys. Other is reduced to distinct keys first."""
    return df.join(other.select(*keys).distinct().withColumn(name, F.lit(1)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: int) -> DataFrame:
    """Full outer match of two sources of one value per key: status both, differs, only_a or only_b."""
    left, right = a.select(*keys, F.col(value).alias("value_a")), b.select(*keys, F.col(value).alias("value_b"))
    joined = left.withColumn("__a", F.lit(True)).join(right.withColumn("__b", F.lit(True)), keys, "full_outer")
    status = F.when(F.col("__b").isNull(), "only_a").when(F.col("__a").isNull(), "only_b").when(F.abs(F.col("value_a") - F.col("value_b")) <= tolerance, "both").otherwise("differs")
    return joined.withColumn("status", status).drop("__a", "__b")


def nearest(df: DataFrame, vector: str, dimension: DataFrame, name: str, centre: str, most: int = 10_000) -> DataFrame:
    """Each row with the nearest row of a dimension (name, centre) and their squared distance; ties go to the smaller name. The dimension travels as
    arrays of structs of about ``most`` rows each, so rows are neither multiplied nor shuffled: one array after another is sent and looked through."""
    parts = max(1, -(-dimension.count() // most))

    def distance(c: Column) -> Column:
        squares = F.zip_with(F.col(vector), c["centre"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
        return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)

    best = []
    for i in range(parts):
        some = dimension.where(F.pmod(F.xxhash64(name), F.lit(parts)) == i)
        packed = some.agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), F.col(centre).alias("centre")))).alias("__all"))
        found = F.array_min(F.transform("__all", lambda c: F.struct(F.round(distance(c), 9).alias("d"), c["name"].alias("name"))))
        df = df.join(F.broadcast(packed)).withColumn(f"__best{i}", found).drop("__all")
        best.append(F.col(f"__best{i}"))
    chosen = F.least(*best) if parts > 1 else best[0]
    return df.withColumn("__best", chosen).drop(*(f"__best{i}" for i in range(parts))).withColumn(f"nearest_{name}", F.col("__best.name")).withColumn("distance2", F.col("__best.d")).drop("__best")


def crosstab(a: DataFrame, b: DataFrame, keys: list[str], row: str, column: str, weight: Column) -> DataFrame:
    """Sums of weight by the labels that two streams have at the same keys."""
    return a.join(b, keys).groupBy(row, column).agg(F.count("*").alias("n"), F.sum(weight).alias("total"))
