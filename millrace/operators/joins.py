"""Joins that an equality does not say: as-of and range joins, without a cross join and without a hot task.

Null keys and null times match nothing; every left row comes out once in an as-of join, and a left row
without a match has nulls. Totals over a range join come from sorted points, without its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], span: float, tolerance: float | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` of the same key at or before its time (a number), named ``right_…``.

    Rows are sorted inside spans of ``span`` units of time for each key, so a key with a third of all rows is spread
    over its spans. What a span takes over from earlier ones is found by a window over one row for each key and span. Of right
    rows at the same time the largest (by ``columns``) counts; with ``tolerance`` older rows do not.
    """
    if span <= 0:
        raise EngineError("bad_args", "span must be above 0")
    at = F.col(time).cast("double")
    value = F.struct(at.alias("t"), *[F.col(c).alias(c) for c in columns])
    nothing = F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)
    bucket = F.floor(at / span)
    r = right.where(F.col(key).isNotNull() & at.isNotNull()).select(F.col(key).alias("__k"), bucket.alias("__b"), at.alias("__t"), value.alias("__v"), F.lit(0).alias("__left"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("__row"))
    rows = left.select(F.col(key).alias("__k"), bucket.alias("__b"), at.alias("__t"), nothing.alias("__v"), F.lit(1).alias("__left"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    # one row for each key and span: the last value in it, taken over by later spans
    last = r.groupBy("__k", "__b").agg(F.max("__v").alias("__last"))
    spans = last.unionByName(rows.where("__k is not null and __b is not null").select("__k", "__b").distinct(), allowMissingColumns=True).groupBy("__k", "__b").agg(F.max("__last").alias("__last"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.withColumn("__old", F.last("__last", ignorenulls=True).over(before)).where("__old is not null").select("__k", "__b", "__old")
    inside = Window.partitionBy("__k", "__b").orderBy("__t", "__left", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = r.unionByName(rows).withColumn("__in", F.last("__v", ignorenulls=True).over(inside)).where("__left = 1").join(carried, ["__k", "__b"], "left")
    found = F.coalesce("__in", "__old")
    fits = F.col("__t").isNotNull() & F.col("__k").isNotNull()
    if tolerance is not None:
        fits = fits & (F.col("__t") - found["t"] <= tolerance)
    return joined.select("__row.*", *[F.when(fits, found[c]).alias(f"right_{c}") for c in columns])


def within(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, key: str | None = None) -> DataFrame:
    """Pairs of a row of ``points`` and a row of ``ranges`` with ``low <= point < high`` (numbers), and equal ``key`` if given.

    Ranges are laid into bins of ``width``, so the join is one on equal bins; choose ``width`` near the usual length of a range.
    Column names of the two sides must differ, but for the key.
    """
    if width <= 0:
        raise EngineError("bad_args", "width must be above 0")
    bin_of = lambda c: F.floor(F.col(c).cast("double") / width)
    r = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(F.sequence(bin_of(low), bin_of(high))))
    p = points.where(F.col(point).isNotNull()).withColumn("__bin", bin_of(point))
    return p.join(r, ["__bin", *([key] if key else [])]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bin")


def within_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, value: str, block: int = 512) -> DataFrame:
    """``ranges`` with ``n``, the rows of ``points`` with ``low <= point < high``, and ``least``, their smallest ``value``; ranges without a point are left out.

    The same as grouping the pairs of ``within``, whose number grows with the product of the two sides; here the work grows with
    their sum. Distinct points and ends of ranges are sorted once and laid into blocks of ``block``, so every end has a place. ``n`` is the
    difference of the counts before the two ends. ``least`` is taken from the rest of the first block, the beginning of the last one and the blocks
    between, which are points of the next level, until one block is left.
    """
    from ..session import cut

    r = ranges.where(F.col(low) < F.col(high))
    ends = r.select(F.col(low).alias("__x")).union(r.select(F.col(high)))
    rows = points.where(F.col(point).isNotNull()).select(F.col(point).alias("__x"), F.lit(1).cast("bigint").alias("__n"), F.col(value).alias("__m"), F.lit(False).alias("__end"))
    nothing = F.lit(None).cast(rows.schema["__m"].dataType)
    places = rows.union(ends.select("__x", F.lit(0).cast("bigint"), nothing, F.lit(True))).groupBy("__x").agg(F.sum("__n").alias("__n"), F.min("__m").alias("__m"), F.max("__end").alias("__end"))
    x, m = (places.schema[c].dataType.simpleString() for c in ("__x", "__m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of one sorted part, numbered, with the ends in them: (place, value, points before in the part)."""
        part, nth, before = TaskContext.get().partitionId(), 0, 0
        for b in _slices(batches, block):
            n = b.column("__n").to_numpy()
            at = np.flatnonzero(b.column("__end").to_numpy(zero_copy_only=False))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            until = before + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([nth], pa.int64()), pa.array([int(n.sum())], pa.int64()), one(b.column("__m")), one(pa.array(at, pa.int32())), one(b.column("__x").take(pa.array(at))), one(pa.array(until[at], pa.int64()))],
                names=["__part", "__nth", "__n", "__ms", "__at", "__xs", "__before"])
            nth, before = nth + 1, before + int(n.sum())

    packed = cut(places.orderBy("__x").mapInArrow(pack, f"__part int, __nth bigint, __n bigint, __ms array<{m}>, __at array<int>, __xs array<{x}>, __before array<bigint>"))
    # as many rows as the sort has partitions
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = packed.groupBy("__part").agg(F.count(F.lit(1)).alias("__blocks"), F.sum("__n").alias("__points")).select(
        "__part", F.coalesce(F.sum("__blocks").over(earlier), F.lit(0)).alias("__first"), F.coalesce(F.sum("__points").over(earlier), F.lit(0)).alias("__earlier"))
    blocks = packed.join(F.broadcast(starts), "__part").withColumn("__block", F.col("__first") + F.col("__nth"))
    placed = blocks.select("__block", "__earlier", F.explode(F.arrays_zip("__at", "__xs", "__before")).alias("e")).select(
        "__block", F.col("e.__at").cast("bigint").alias("__at"), F.col("e.__xs").alias("__x"), (F.col("__earlier") + F.col("e.__before")).alias("__before"))
    side = lambda c, name: placed.select(F.col("__x").alias(f"__{name}_x"), F.col("__block").alias(f"__{name}"), F.col("__at").alias(f"__{name}_at"), F.col("__before").alias(f"__{name}_before"))
    got = r.join(side(low, "a"), F.col(low) == F.col("__a_x")).join(side(high, "b"), F.col(high) == F.col("__b_x"))
    got = got.withColumn("n", F.col("__b_before") - F.col("__a_before")).where("n > 0").withColumn("least", nothing).select(*ranges.columns, "n", "least", "__a", "__a_at", "__b", "__b_at")
    level, size = blocks.select("__block", "__ms"), packed.count()
    least = lambda found: [F.least("least", F.array_min(found)).alias("least") if c == "least" else c for c in got.columns]
    while True:  # each side is read before the next join, so no block is carried through a shuffle
        until = F.when(F.col("__a") == F.col("__b"), F.col("__b_at") - F.col("__a_at")).otherwise(block)
        got = got.join(level.withColumnRenamed("__block", "__a"), "__a", "left").select(*least(F.slice("__ms", F.col("__a_at").cast("int") + 1, until.cast("int"))))
        got = got.join(level.withColumnRenamed("__block", "__b"), "__b", "left").select(*least(F.when(F.col("__a") < F.col("__b"), F.slice("__ms", F.lit(1), F.col("__b_at").cast("int")))))
        between = lambda c: F.when(F.col("__a") + 1 < F.col("__b"), c)
        up = {"__a": between(F.floor((F.col("__a") + 1) / block)), "__a_at": between((F.col("__a") + 1) % block), "__b": between(F.floor(F.col("__b") / block)), "__b_at": between(F.col("__b") % block)}
        got = got.select(*ranges.columns, "n", "least", *[c.alias(k) for k, c in up.items()])
        if size <= 1:
            return got.drop(*up)
        level = level.select(F.floor(F.col("__block") / block).alias("__up"), F.struct("__block", F.array_min("__ms").alias("m")).alias("s")).groupBy("__up").agg(F.sort_array(F.collect_list("s")).alias("s")).select(F.col("__up").alias("__block"), F.col("s.m").alias("__ms"))
        size = -(-size // block)


def _slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size``, the last one shorter."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while held and b.num_rows or b.num_rows >= size:
            need = size - sum(h.num_rows for h in held)
            held.append(b.slice(0, need))
            b = b.slice(min(need, b.num_rows))
            if sum(h.num_rows for h in held) == size:
                yield pa.concat_batches(held)
                held = []
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.concat_batches(held)


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with row numbers from 1 in an order, without gathering all rows in one task: rows are sorted into
    ranges, and each range starts where the ranges before it end (one count for each range)."""
    from ..session import cut

    placed = cut(df.orderBy(*order)).withColumn("__part", F.spark_partition_id()).withColumn("__nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # as many rows as the sort has partitions
    starts = sizes.withColumn("__start", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).select("__part", F.coalesce("__start", F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + F.col("__nth") + 1).cast("bigint")).drop("__part", "__nth", "__start")
