"""Choosing thresholds: Pareto front, knee of a curve, recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callgrove.shared import written


def pareto_front(df: DataFrame, m1: str, m2: str, max1: bool = True, max2: bool = False, by: list[str] = ()) -> DataFrame:
    """Rows that no row of their group beats in one metric without losing in the other; exact ties all stay.

    Best m1 for each m2, then a running best over m2: one sort of the distinct m2 instead of a join of pairs.
    """
    a = F.col(m1) if max1 else -F.col(m1)
    b = -F.col(m2) if max2 else F.col(m2)
    rows = df.where(F.col(m1).isNotNull() & F.col(m2).isNotNull()).withColumns({"__a": a, "__b": b})
    best = rows.groupBy(*by, "__b").agg(F.max("__a").alias("__best"))
    before = F.max("__best").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("__prev", before).where(F.col("__prev").isNull() | (F.col("__best") > F.col("__prev"))).drop("__prev")
    joined = rows.join(front, [*by, "__b"])
    return joined.where(F.col("__a") == F.col("__best")).select(*df.columns)


def kneedle(df: DataFrame, x: str, y: str, by: list[str], curve: str = "concave", direction: str = "increasing", s: float = 1.0, weights: tuple[str, str] | None = None) -> DataFrame:
    """The knee of each group's curve: x and y scaled to 0..1, turned so that a knee is a maximum of the difference curve.

    A local maximum is a knee if the difference falls below its threshold (the maximum less s mean steps of x) before the
    next maximum; the first one counts, none gives NULL. weights: two columns that weigh x and y.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = rows.groupBy(*by, F.col(x).alias("x")).agg((F.max if direction == "increasing" else F.min)(y).alias("y"))
    g = Window.partitionBy(*by)
    scaled = points.withColumns({"xs": F.try_divide(F.col("x") - F.min("x").over(g), F.max("x").over(g) - F.min("x").over(g)), "ys": F.try_divide(F.col("y") - F.min("y").over(g), F.max("y").over(g) - F.min("y").over(g))})
    turned = (1 - F.col("ys")) if curve == "convex" else F.col("ys")
    if (curve, direction) in (("concave", "decreasing"), ("convex", "increasing")):
        scaled = scaled.withColumn("xs", 1 - F.col("xs"))
    wx, wy = (F.col(weights[0]), F.col(weights[1])) if weights else (F.lit(1.0), F.lit(1.0))
    o = g.orderBy("xs")
    d = scaled.withColumn("d", wy * turned - wx * F.col("xs"))
    peaks = d.withColumns({"prev": F.lag("d").over(o), "next": F.lead("d").over(o), "place": F.row_number().over(o), "step": F.try_divide(F.lit(1.0), F.count("*").over(g) - 1)})
    top = F.coalesce(F.col("d") >= F.col("prev"), F.lit(False)) & F.coalesce(F.col("d") >= F.col("next"), F.lit(False))
    marked = peaks.withColumn("limit", F.when(top, F.col("d") - s * F.col("step")))
    running = marked.withColumns({"peak": F.last(F.when(top, F.struct("place", "x", "y", "limit")), ignorenulls=True).over(o.rowsBetween(Window.unboundedPreceding, 0))})
    fallen = running.where(F.col("peak").isNotNull() & (F.col("d") < F.col("peak.limit")))
    return fallen.groupBy(*by).agg(F.min("peak").alias("k")).select(*by, F.col("k.x").alias("knee_x"), F.col("k.y").alias("knee_y"))


def recommend(summary: DataFrame, m1: str, m2: str, weights: list[float], by: list[str], params: list[str], max1: bool = True) -> DataFrame:
    """For each weight the parameters at the knee of the Pareto front of (m1 best, m2 least); ties go to the least parameters."""
    spark = summary.sparkSession
    front = pareto_front(summary.select(*by, *params, m1, m2), m1, m2, max1, False, by)
    weighed = front.crossJoin(F.broadcast(spark.createDataFrame([(float(w), 1.0) for w in weights], "weight double, one double")))
    knees = kneedle(weighed, m2, m1, [*by, "weight", "one"], "concave" if max1 else "convex", "increasing" if max1 else "decreasing", weights=("one", "weight"))
    at = weighed.join(knees, [*by, "weight", "one"]).where((F.col(m2) == F.col("knee_x")) & (F.col(m1) == F.col("knee_y")))
    return at.groupBy(*by, "weight").agg(F.min(F.struct(*params, m1, m2)).alias("r")).select(*by, "weight", "r.*")


def by_number(chrom: Column) -> Column:
    """Sort key of chromosome names: their number, names without one last."""
    return F.coalesce(F.regexp_replace(chrom, "^chr", "").try_cast("int"), F.lit(1000))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the order of the given columns; equal rows have places next to each other.

    Rows are dealt to partitions by ranges and sorted there; counts of the partitions, a row for each, tell where a partition begins.
    """
    numbered = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    counts = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as partitions
    bases = counts.select("__part", before.alias("__before"))
    within = F.col("__at") - F.shiftleft(F.col("__part"), 33)
    return numbered.withColumn("__part", part).join(F.broadcast(bases), "__part").withColumn(name, F.col("__before") + within + 1).drop("__at", "__part", "__before")
