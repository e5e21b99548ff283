"""Exact percentiles of groups of any size.

`percentile` keeps every distinct value of a group in one task. Here a group is narrowed down first: a histogram of equal ranges between
its least and largest value, summed in all partitions, says in which range the wanted ranks lie; that range becomes the next
histogram's, until it holds few rows or one value. What a task holds is bounded by the number of ranges and by those few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecshift.sources.snapshots import written

#: Ranges of a histogram, and rows of a group (or a range) that one task may sort.
RANGES, FEW = 1024, 100_000


def exact_percentiles(df: DataFrame, value: str, points: tuple[float, ...], by: tuple[str, ...] = (), ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """by, n, p (array in the order of points) with linear interpolation, as `percentile` gives them. Null and NaN values don't count; a
    group without others has n 0 and null percentiles; infinite values are an error. Groups may be as many as a shuffle holds."""
    if not points or not all(0 <= p <= 1 for p in points):
        raise ValueError("percentiles lie between 0 and 1")
    keys = [f"__k{i}" for i in range(len(by))]
    v = F.col(value).cast("double")
    v = F.when(F.abs(v) == float("inf"), F.raise_error(F.lit("an infinite value has no rank")).cast("double")).when(~F.isnan(v), v)
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], v.alias("__v"))
    groups = written(rows.groupBy(*keys).agg(F.count("__v").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")), "groups")
    rows = rows.where("__v IS NOT NULL")
    # the ranks (from 0) that the points need; lo..hi is where each lies, `below` how many rows are less than lo, `inside` how many are in it
    at = lambda p: p * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in points])))
    wanted = groups.where("n > 0").select(*keys, "n", F.explode(ranks.cast("array<bigint>")).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wanted = written(wanted, "wanted")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    within = F.col("r.__v").between(F.col("w.lo"), F.col("w.hi"))
    open_ = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    done = []
    while not (wide := wanted.where(open_)).isEmpty():
        done.append(wanted.where(~open_))
        # one histogram for ranks that lie in the same range
        spans = wide.select(*keys, "lo", "hi").distinct()
        v, lo, hi = F.col("r.__v"), F.col("w.lo"), F.col("w.hi")
        share = F.when(hi - lo < float("inf"), (v - lo) / (hi - lo)).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        place = F.least(F.lit(ranges - 1), F.floor(share * ranges)).cast("int")  # the least value's and the greatest's differ
        x = rows.alias("r").join(spans.alias("w"), [*same, within] if same else within)
        x = x.select(*[F.col(f"r.{k}").alias(k) for k in keys], "w.lo", "w.hi", place.alias("place"), "r.__v")
        bins = x.groupBy(*keys, "lo", "hi", "place").agg(F.count(F.lit(1)).alias("m"), F.min("__v").alias("least"), F.max("__v").alias("most"))
        order = Window.partitionBy(*keys, "lo", "hi").orderBy("place")  # at most `ranges` rows
        bins = bins.withColumn("before", F.sum("m").over(order) - F.col("m"))
        hit = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("w.lo") == F.col("b.lo"), F.col("w.hi") == F.col("b.hi")]
        offset = F.col("w.rank") - F.col("w.below")
        hit += [offset >= F.col("b.before"), offset < F.col("b.before") + F.col("b.m")]
        x = wide.alias("w").join(bins.alias("b"), hit)
        wanted = written(x.select(*[f"w.{k}" for k in keys], "w.n", "w.rank", F.col("b.least").alias("lo"), F.col("b.most").alias("hi"), (F.col("w.below") + F.col("b.before")).alias("below"), F.col("b.m").alias("inside")), "wanted")
    for d in done:
        wanted = wanted.unionByName(d)
    spans = wanted.where("lo < hi").select(*keys, "lo", "hi").distinct()
    x = rows.alias("r").join(spans.alias("w"), [*same, within] if same else within)
    x = x.select(*[F.col(f"r.{k}").alias(k) for k in keys], "w.lo", "w.hi", "r.__v")
    x = x.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "lo", "hi").orderBy("__v")) - 1)  # at most `few` rows
    hit = [F.col(f"w.{k}").eqNullSafe(F.col(f"x.{k}")) for k in keys] + [F.col("w.lo") == F.col("x.lo"), F.col("w.hi") == F.col("x.hi"), F.col("x.i") == F.col("w.rank") - F.col("w.below")]
    picked = wanted.where("lo < hi").alias("w").join(x.alias("x"), hit).select(*[f"w.{k}" for k in keys], "w.rank", F.col("x.__v").alias("value"))
    picked = picked.unionByName(wanted.where("lo >= hi").select(*keys, "rank", F.col("lo").alias("value")))
    found = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))  # two entries a point
    match = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    x = groups.alias("g").join(found.alias("f"), match, "left") if keys else groups.alias("g").join(found.alias("f"), how="left")

    def interpolated(p: float):
        low, high = F.floor(at(p)).cast("long"), F.ceil(at(p)).cast("long")
        a, b = F.col("m")[low], F.col("m")[high]
        return F.when((low == high) | (a == b), a).otherwise((high - at(p)) * a + (at(p) - low) * b)

    p = F.array(*[F.when(F.col("n") > 0, interpolated(p)) for p in points])
    return x.select(*[F.col(f"g.{k}").alias(c) for c, k in zip(by, keys, strict=True)], F.col("g.n").alias("n"), p.alias("p"))
