"""Exact quantiles of groups of any size, by rounds that narrow the stretch of values in which an order statistic lies.

percentile() keeps a group's values in one task. Here each round reads the rows that still lie in a sought stretch and aggregates them with
map-side combination: a sketch of GRID cuts (percentile_approx) chooses a narrower stretch, and counts of what lies under, on, between and over its ends say
where the rank really is. What a sketch got wrong costs a round, never the result; a value that repeats is found on a cut. Stretches of
SMALL rows or fewer are sorted as they are. A round keeps about 3 rows of GRID, so rounds grow with the logarithm of the largest group.

Sought stretches (two a group and quantile) meet the rows by group: broadcast up to SENT of them, beyond that in a join whose groups are dealt
to SALTS parts by the rows' input partition, so no group is one task's.

Defined cases: nulls, NaN and infinities don't count; a group without other values is left out; null keys are a group; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import stored

GRID, ACCURACY, SMALL, SENT, SALTS, ROUNDS = 512, 10_000, 4096, 20_000, 16, 40


def _meet(values: DataFrame, sought: DataFrame, by: list[str], many: int) -> DataFrame:
    """Rows (_v) with the sought stretches of their group that they lie in, ends left out."""
    sought = sought.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_k", "_r", "_lo", "_hi", "_before", "_inside", "_low", "_high")
    same = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    if many <= SENT:
        return values.join(F.broadcast(sought), same)
    salted = sought.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return values.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(salted, same & (F.col("_s") == F.col("_t"))).drop("_s", "_t")


def _looked(values: DataFrame, open_: DataFrame, by: list[str], many: int) -> DataFrame:
    """Sought stretches with their value, if they are small, or else a narrower stretch to try (_low, _high)."""
    small = F.col("_inside") <= SMALL
    met = _meet(values, open_, by, many).groupBy(*by, "_k", "_r", "_lo", "_hi", "_before", "_inside")
    at = F.col("_r") - F.col("_before")
    grid = F.percentile_approx(F.when(~small, F.col("_v")), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]), ACCURACY)
    found = met.agg(F.sort_array(F.collect_list(F.when(small, F.col("_v")))).alias("_all"), grid.alias("_grid"))
    share = at / (F.col("_inside") - 1) * GRID
    cut = lambda i: F.get("_grid", F.greatest(F.least(i, F.lit(GRID)), F.lit(0)).cast("int"))
    value, low, high = F.when(small, F.get("_all", at.cast("int"))), F.when(~small, cut(F.floor(share) - 1)), F.when(~small, cut(F.ceil(share) + 1))
    return found.select(*by, "_k", "_r", "_lo", "_hi", "_before", "_inside", value.alias("_value"), low.alias("_low"), high.alias("_high"))


def _counted(values: DataFrame, tried: DataFrame, by: list[str], many: int) -> DataFrame:
    """Stretches tried with their value, if it stands on a cut, or else the part that the rank lies in."""
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    met = _meet(values, tried, by, many).groupBy(*by, "_k", "_r", "_lo", "_hi", "_before", "_inside", "_low", "_high")
    n = met.agg(F.count_if(v < low).alias("_a"), F.count_if(v == low).alias("_b"), F.count_if((v > low) & (v < high)).alias("_c"), F.count_if((v == high) & (high > low)).alias("_d"))
    at, a, b, c, d = F.col("_r") - F.col("_before"), F.col("_a"), F.col("_a") + F.col("_b"), F.col("_a") + F.col("_b") + F.col("_c"), F.col("_a") + F.col("_b") + F.col("_c") + F.col("_d")
    under, on_low, between, on_high = at < a, at < b, at < c, at < d
    part = lambda x, y, z: F.when(under, x).when(between, y).otherwise(z)
    return n.select(
        *by,
        "_k",
        "_r",
        part(F.col("_lo"), low, high).alias("_lo"),
        part(low, high, F.col("_hi")).alias("_hi"),
        (F.col("_before") + part(F.lit(0), b, d)).alias("_before"),
        part(a, F.col("_c"), F.col("_inside") - d).alias("_inside"),
        F.when(under, F.lit(None)).when(on_low, low).when(between, F.lit(None)).when(on_high, high).alias("_value"),
        F.lit(None).cast("double").alias("_low"),
        F.lit(None).cast("double").alias("_high"),
    )


def quantiles(df: DataFrame, by: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """by, n and a column for each of shares (name: q): the quantile of x, linear between order statistics."""
    value = F.col(x).cast("double")
    values = df.select(*by, value.alias("_v")).where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    groups = stored(values.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"))
    none = F.lit(None).cast("double")
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = [F.struct(F.lit(name).alias("_k"), f(place(q)).cast("long").alias("_r")) for name, q in shares.items() for f in (F.floor, F.ceil)]
    sought = groups.select(*by, "n", F.explode(F.array_distinct(F.array(*ranks))).alias("s")).select(*by, "s.*", none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_before"), F.col("n").alias("_inside"), none.alias("_value"), none.alias("_low"), none.alias("_high"))
    done, many = [], stored(sought)
    for _ in range(ROUNDS):
        count = many.count()
        if not count:
            break
        looked = stored(_looked(values, many, by, count))
        done.append(looked.where("_value IS NOT NULL").select(*by, "_k", "_r", "_value"))
        tried = looked.where("_value IS NULL")
        if not (left := tried.count()):
            break
        many = stored(_counted(values, tried, by, left))
        done.append(many.where("_value IS NOT NULL").select(*by, "_k", "_r", "_value"))
        many = many.where("_value IS NULL")
    else:
        raise RuntimeError(f"quantiles not found within {ROUNDS} rounds")
    found = done[0] if done else many.select(*by, "_k", "_r", "_value")
    for more in done[1:]:
        found = found.unionByName(more)
    ends = found.groupBy(*by, "_k").agg(F.min_by("_value", "_r").alias("_a"), F.max_by("_value", "_r").alias("_b")).groupBy(*by).pivot("_k", [*shares]).agg(F.first(F.struct("_a", "_b")))
    same = F.lit(True)
    for i, c in enumerate(by):
        ends, same = ends.withColumnRenamed(c, f"_{i}"), same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    out = groups.join(ends, same)
    return out.select(*by, "n", *[(F.col(f"{k}._a") + (F.col(f"{k}._b") - F.col(f"{k}._a")) * (place(q) - F.floor(place(q)))).alias(k) for k, q in shares.items()])
