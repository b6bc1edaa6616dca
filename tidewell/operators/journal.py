"""Review of decision journals: rows of (book, n, d, kind, amount, limit_price, vs_sma200, mood, result), one book a reviewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Kinds of decisions, and the moods in which deciding is risky.
ENTER, LEAVE, NOTHING = ["Entrar", "Ampliar"], ["Reducir", "Salir"], "No hacer nada"
RISKY = ["Con prisa / miedo a perderlo", "Confiado tras un acierto", "Frustrado tras un error"]
#: Rows under which a book isn't reviewed.
LEAST = 10
#: Least entries with an amount and least results behind size_after_result(); entries with a distance from the average, rows with a mood,
#: rows with mood and result, and such rows on either side behind patterns().
ENTRIES, RESULTS, CHASES, MOODS, OUTCOMES, SIDE = 4, 3, 4, 6, 8, 3


def wins(result: str = "result"):
    return F.lower(F.col(result)).startswith("g")


def unkept_limits(journal: DataFrame, price: float) -> DataFrame:
    """Entries whose limit the price has crossed and after which no exit stands in the book."""
    opened = journal.where(F.col("kind").isin(*ENTER) & (F.col("limit_price") > price))
    exits = journal.where(F.col("kind").isin(*LEAVE)).groupBy("book").agg(F.max("d").alias("last_exit"))
    return opened.join(exits, "book", "left").where(F.col("last_exit").isNull() | (F.col("last_exit") <= F.col("d"))).select("book", "n", "d", "limit_price")


def size_after_result(journal: DataFrame) -> DataFrame:
    """Mean amount after a won and after a lost operation; flagged when it is 1.3 times as much after wins.

    Books with fewer than ENTRIES entries or RESULTS results are left out.
    """
    entry = F.col("kind").isin(*ENTER) & F.col("amount").isNotNull()
    # the last result dated before the day, carried along the book's days
    days = journal.groupBy("book", "d").agg(F.max_by("result", F.when(F.col("result").isNotNull(), F.col("n"))).alias("own"))
    before = F.last("own", ignorenulls=True).over(W.partitionBy("book").orderBy("d").rowsBetween(W.unboundedPreceding, -1))
    previous = days.select("book", "d", before.alias("previous"))
    enough = journal.groupBy("book").agg(F.count_if(entry).alias("e"), F.count("result").alias("o")).where((F.col("e") >= ENTRIES) & (F.col("o") >= RESULTS))
    ranked = journal.where(entry).join(enough.select("book"), "book", "left_semi").withColumn("i", F.row_number().over(W.partitionBy("book").orderBy("d", "n")))
    x = ranked.where("i > 1").join(previous, ["book", "d"]).where("previous IS NOT NULL")
    won = wins("previous")
    got = x.groupBy("book").agg(F.count_if(won).alias("n_won"), F.count_if(~won).alias("n_lost"), F.avg(F.when(won, F.col("amount"))).alias("after_won"), F.avg(F.when(~won, F.col("amount"))).alias("after_lost"))
    flagged = (F.col("n_won") >= 2) & (F.col("n_lost") >= 2) & (F.col("after_won") > F.col("after_lost") * 1.3)
    return got.withColumn("flagged", F.coalesce(flagged, F.lit(False)))


def patterns(journal: DataFrame) -> DataFrame:
    """One row a book of LEAST rows or more: shares behind each detector and whether it strikes."""
    order = W.partitionBy("book").orderBy("d", "n")
    active = F.col("kind") != NOTHING
    numbered = journal.withColumn("a", F.when(active, F.sum(active.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))).withColumn("actives", F.sum(active.cast("int")).over(W.partitionBy("book")))
    first = active & (F.col("a") <= F.floor(F.col("actives") / 2))
    second = active & (F.col("a") > F.floor(F.col("actives") / 2))
    entry, risky, result = F.col("kind").isin(*ENTER), F.col("mood").isin(*RISKY), F.col("result").isNotNull()
    span = lambda c: F.greatest(F.date_diff(F.max(F.when(c, F.col("d"))), F.min(F.when(c, F.col("d")))), F.lit(1))
    rate = lambda c: F.count_if(c) / span(c) * 30
    share = lambda part, all_: F.count_if(part & all_) / F.when(F.count_if(all_) > 0, F.count_if(all_))
    mood = F.col("mood").isNotNull()
    got = numbered.groupBy("book").agg(
        F.count("*").alias("n"),
        F.count_if(entry).alias("entries"),
        F.count_if(entry & F.col("vs_sma200").isNotNull()).alias("placed"),
        F.count("mood").alias("moods"),
        F.count_if(result & mood & risky).alias("risky_results"),
        F.count_if(result & mood & ~risky).alias("calm_results"),
        share(F.col("limit_price").isNull(), entry).alias("without_limit"),
        share(F.col("vs_sma200") > 20, entry & F.col("vs_sma200").isNotNull()).alias("chased"),
        share(risky, mood).alias("in_risk"),
        F.avg(F.when(result & mood & risky, wins().cast("double"))).alias("won_in_risk"),
        F.avg(F.when(result & mood & ~risky, wins().cast("double"))).alias("won_calm"),
        rate(first).alias("rate1"),
        rate(second).alias("rate2"),
        F.count_if(active).alias("actives"),
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    numbers = {c: F.round(c, 6) for c in ("without_limit", "chased", "in_risk", "won_in_risk", "won_calm", "rate1", "rate2")}
    flagged = got.where(F.col("n") >= LEAST).select(
        "book", "n", "entries", *[c.alias(k) for k, c in numbers.items()],
        flag((F.col("entries") >= 3) & (F.col("without_limit") > 0.3)).alias("no_limits"),
        flag((F.col("placed") >= CHASES) & (F.col("chased") > 0.5)).alias("chases"),
        flag((F.col("moods") >= MOODS) & (F.col("in_risk") > 0.4)).alias("risky_mood"),
        flag((F.col("risky_results") + F.col("calm_results") >= OUTCOMES) & (F.least("risky_results", "calm_results") >= SIDE) & (F.col("won_calm") - F.col("won_in_risk") > 0.2)).alias("mood_costs"),
        flag((F.col("actives") >= 8) & (F.col("rate2") > F.col("rate1") * 1.5)).alias("faster"),
    )
    return flagged


def statistics(journal: DataFrame) -> DataFrame:
    """Counts, share of wins and the most frequent mood (ties: the one seen first)."""
    moods = journal.where("mood IS NOT NULL").groupBy("book", "mood").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    top = moods.groupBy("book").agg(F.max_by("mood", F.struct("c", -F.col("first"))).alias("mood"))
    got = journal.groupBy("book").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") != NOTHING).alias("active"),
        F.count("limit_price").alias("with_limit"),
        F.count("result").alias("reviewed"),
        F.round(100 * F.avg(F.when(F.col("result").isNotNull(), wins().cast("double"))), 6).alias("won"),
    )
    return got.join(top, "book", "left")
