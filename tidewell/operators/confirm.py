"""Before and after the tests: whether a mask's geometry admits them, and whether what came later confirms an effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import series as S
from tidewell.operators import calendar, panel, stats

# Outcomes of the forward confirmation.
CONFIRMED, REJECTED, PENDING = "CONFIRMADA", "RECHAZADA_FORWARD", "PENDIENTE_REVISION"
BLOCKS, BLOCK_DAYS = 5, 91


def forward(df: DataFrame, ends: DataFrame, least: float, horizon: int = 30) -> DataFrame:
    """df: series, d, m, r; ends: series, z, theta (the tested effect and the last day it saw). One row a series with the outcome.

    BLOCKS blocks of BLOCK_DAYS days follow z; days of the last horizon days of a block are left out. A block's sign is that of its effect, 0 counts
    against, a block without masked or without other days is undefined. More than half of the blocks must have theta's sign, the effect over
    all of them that sign too and at least half theta's size and least.
    """
    blocks = calendar.forward_blocks(ends.select("series", "z"), BLOCKS, BLOCK_DAYS, BLOCK_DAYS - horizon).withColumnRenamed("series", "_s")
    inside = (F.col("series") == F.col("_s")) & F.col("d").between(F.col("a"), F.col("last_eligible"))
    kept = df.join(blocks, inside).select("series", "block", "m", "r")
    sign = F.signum("theta").cast("int")
    each = kept.groupBy("series", "block").agg(stats.theta().alias("t"))
    every = blocks.select(F.col("_s").alias("series"), "block").join(each, ["series", "block"], "left").join(ends.select("series", "theta"), "series")
    votes = every.groupBy("series", "theta").agg(F.count("t").alias("defined"), F.count_if((F.col("t") != 0) & (F.signum("t") == sign)).alias("same"))
    whole = kept.groupBy("series").agg(stats.theta().alias("theta_f"), F.count("*").alias("days"))
    j = votes.join(whole, "series", "left").withColumn("verdict", stats.majority(F.col("same"), F.col("defined")))
    passes = (F.col("verdict") == "yes") & (F.signum("theta_f") == F.signum("theta")) & (F.abs("theta_f") >= F.greatest(F.abs("theta") / 2, F.lit(least)))
    outcome = F.when(F.col("verdict") == "none", PENDING).when(F.coalesce(passes, F.lit(False)), CONFIRMED).otherwise(REJECTED)
    return j.select("series", "defined", "same", F.coalesce("days", F.lit(0)).alias("days"), "verdict", *S.rounded(theta=F.col("theta"), theta_f=F.col("theta_f")), outcome.alias("outcome"))


def forward_problems(ends: DataFrame, metric: DataFrame, price: DataFrame, old_metric: DataFrame, old_price: DataFrame, horizon: int = 30) -> DataFrame:
    """ends: series, z, theta; the others: series, d, value, as they are now and as they were in the test. series, problem: why a series can't be confirmed yet.

    The first that holds: no theta, theta of 0 (it has no sign), what the test saw of the metric or the price is gone or has changed, the metric ends
    before the last eligible day, the price before the returns of that day are known. The window is never shortened. Null: nothing stands against it.
    Defined cases: a series without old rows has nothing to contradict; one without rows now ends early; a theta that is NaN counts as none.
    """
    window = calendar.forward_blocks(ends.select("series", "z"), BLOCKS, BLOCK_DAYS, BLOCK_DAYS - horizon)
    due = window.groupBy("series").agg(F.max("last_eligible").alias("eligible"), F.date_add(F.max("last_eligible"), horizon).alias("known"))
    got = ends.select("series", "theta").join(due, "series", "left")
    for name, old, new in (("metric", old_metric, metric), ("price", old_price, price)):
        same = panel.overlap_diff(old, new).select("series", F.col("identical").alias(f"{name}_same"))
        got = got.join(same, "series", "left").join(new.where("value IS NOT NULL").groupBy("series").agg(F.max("d").alias(f"{name}_last")), "series", "left")
    early = lambda last, day: F.coalesce(F.col(last) < F.col(day), F.lit(True))
    problem = (
        F.when(F.col("theta").isNull() | F.isnan("theta"), "no theta").when(F.col("theta") == 0, "theta is 0")
        .when(~F.col("metric_same"), "metric revised").when(~F.col("price_same"), "price revised")
        .when(early("metric_last", "eligible"), "metric ends early").when(early("price_last", "known"), "price ends early")
    )
    return got.select("series", problem.alias("problem"))


def checked_forward(df: DataFrame, ends: DataFrame, problems: DataFrame, least: float, horizon: int = 30) -> DataFrame:
    """forward() of the series without a problem; the others have one row too, with their problem and no outcome."""
    sound = ends.join(problems.where("problem IS NULL"), "series", "left_semi")
    return problems.join(forward(df, sound, least, horizon), "series", "left")


def admissibility(df: DataFrame, base: DataFrame, horizon: int = 30, segments: int = 4, least_segment: float = 3.0, least_all: float = 10.0, least_masked: int = 30, least_episodes: int = 5) -> DataFrame:
    """df: series, d, m, r (r null where it is unknown); base: series, d of days with all base variables. One row a series: counts, problems and admissible.

    The days of the first half of the span make block 1, the others block 2. flat: segments of block 1 where the mask doesn't vary (or under 3 days with r);
    thin: those with fewer than least_segment effective observations (days over the horizon).
    """
    ends = df.groupBy("series").agg(F.min("d").alias("first"), F.max("d").alias("last")).withColumn("cut", F.date_add("first", F.floor(F.date_diff("last", "first") / 2).cast("int")))
    x = df.join(ends.select("series", "cut"), "series").withColumn("one", F.col("d") <= F.col("cut"))
    one, two = x.where("one").drop("one", "cut"), x.where("NOT one")
    known = F.col("r").isNotNull()
    parts = calendar.in_segments(one, segments).groupBy("series", "segment").agg(
        F.count("*").alias("days"), F.count_if(known).alias("n"), F.count_if(known & F.col("m")).alias("c")
    )
    flat = ~((F.col("n") >= 3) & (F.col("c") > 0) & (F.col("c") < F.col("n")))
    thin = F.col("days") / horizon < least_segment
    listed = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.col("segment")))), lambda k: k.cast("string")), ",")
    by_part = parts.groupBy("series").agg(listed(flat).alias("flat"), listed(thin).alias("thin"))
    third = one.where(known).join(base.select("series", "d"), ["series", "d"], "left_semi").groupBy("series").agg((F.count("*") / horizon).alias("effective"))
    masked = two.where(known & F.col("m")).select("series", "d")
    found = masked.groupBy("series").agg(F.count("*").alias("masked"))
    episodes = calendar.episodes(masked, horizon).groupBy("series").agg(F.count("*").alias("episodes"))
    run = stats.runs(df).where("m").groupBy("series").agg(F.avg("n").alias("run"))
    got = df.groupBy("series").agg(F.count("*").alias("n"), F.count_if("m").alias("active"))
    for other in (run, by_part, third, found, episodes):
        got = got.join(other, "series", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ok = (F.col("flat") == "") & (F.col("thin") == "") & (zero("effective") >= least_all) & (zero("masked") >= least_masked) & (zero("episodes") >= least_episodes)
    return got.select("series", "n", "active", "flat", "thin", *S.rounded(run=zero("run"), effective=zero("effective")), zero("masked").alias("masked"), zero("episodes").alias("episodes"), ok.alias("admissible"))
