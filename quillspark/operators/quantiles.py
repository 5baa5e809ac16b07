"""Exact quantiles by bracketed selection: tasks hold a histogram's buckets, never the values of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

#: Buckets that a bracket is cut into in each pass.
BUCKETS = 1024
#: Brackets (some 60 bytes each) that are broadcast; more meet the values in a shuffle.
BROADCAST_BRACKETS = 100_000


def _scaled(x: Column, pass_no: int) -> Column:
    """Values as they are in every second pass, else by the logarithm of their size: both keep the order, the one cuts near values, the other far ones."""
    return F.signum(x) * F.log1p(F.abs(x)) if pass_no % 2 == 0 else x


def ranked_values(values: DataFrame, ranks: DataFrame) -> DataFrame:
    """g, name, rank, value: the value of each wanted rank (from 0) of each group.

    values: g, name, x (finite numbers). ranks: g, name, low and high (the group's least and greatest value), rank.

    A pass cuts each wanted rank's bracket into buckets, which tasks count before rows are dealt, and goes on with the bucket in which the rank
    falls and with the least and the greatest value in it, until those are equal. Passes are few: a bracket's values are divided by the number of
    buckets in each, and any two different values are told apart in two.
    """
    state = stored(ranks.select("g", "name", "rank", "low", "high", F.lit(0).cast("long").alias("below")), "quantile-ranks")
    done, pass_no = [state.filter("low = high")], 0
    while True:
        wanted = state.filter("low < high")
        brackets = stored(wanted.select("g", "name", "low", "high").distinct(), "quantile-brackets")
        n = brackets.limit(BROADCAST_BRACKETS + 1).count()
        if not n:
            break
        met = values.join(F.broadcast(brackets) if n <= BROADCAST_BRACKETS else brackets, ["g", "name"]).filter(F.col("x").between(F.col("low"), F.col("high")))
        low, high, x = (_scaled(F.col(c), pass_no) for c in ("low", "high", "x"))
        part = F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))
        bucket = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int").alias("bucket")
        counts = met.groupBy("g", "name", "low", bucket).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("g", "name", "low").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = counts.withColumn("before", before)
        chosen = wanted.join(inside, ["g", "name", "low"]).filter((F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("n")))
        state = stored(chosen.select("g", "name", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below")), "quantile-ranks")
        done.append(state.filter("low = high"))
        pass_no += 1
    return reduce(DataFrame.unionByName, done).select("g", "name", "rank", F.col("low").alias("value"))


def quantiles(df: DataFrame, by: list[str], values: dict[str, Column], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The columns of by, name, n, mean, std (of a sample), min, max, and q, an array of the exact quantiles (linear between neighbours), of each named value in each group.

    Nulls and numbers that are not finite are left out; a group without any other has an n of 0 and nulls. A null in a column of by is a group
    of its own. The values are stored once, as numbers only, and read in each pass, so that what they are made from is evaluated once.
    """
    key = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), c.cast("double").alias("x")) for n, c in values.items())))
    # -0.0 and 0.0 are one value
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x") + 0.0).alias("x")
    rows = stored(df.select(key.alias("g"), each.alias("v")).select("g", "v.name", "v.x").select("g", "name", finite), "quantile-values")
    groups = rows.groupBy("g", "name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    groups = stored(groups, "quantile-groups")
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    both = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in at))))
    found = ranked_values(rows.filter("x IS NOT NULL"), groups.filter("n > 0").select("g", "name", "low", "high", F.explode(both).alias("rank")))
    maps = found.groupBy("g", "name").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    listed = groups.join(maps, ["g", "name"], "left")

    def between(q: float) -> Column:
        a, z = F.floor(place(q)), F.ceil(place(q))
        low, high = F.try_element_at("m", a), F.try_element_at("m", z)
        return F.when((a == z) | (low == high), low).otherwise((z - place(q)) * low + (place(q) - a) * high)

    stats = (F.col("low").alias("min"), F.col("high").alias("max"), F.array(*map(between, at)).alias("q"))
    return listed.select(*(F.col("g").getField(c).alias(c) for c in by), "name", "n", "mean", "std", *stats)
