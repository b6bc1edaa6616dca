import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import confirm, rules

Z = dt.date(2020, 1, 1)


def day(i):
    return Z + dt.timedelta(i)


def series(spark, rows):
    return spark.createDataFrame(rows, "series string, d date, value double")


@pytest.mark.parametrize(
    ("theta", "metric_to", "price_to", "change", "want"),
    [
        (0.1, 425, 455, {}, None),
        (None, 425, 455, {}, "no theta"),
        (float("nan"), 425, 455, {}, "no theta"),
        (0.0, 425, 455, {}, "theta is 0"),
        (0.1, 424, 455, {}, "metric ends early"),
        (0.1, 425, 454, {}, "price ends early"),
        (0.1, 424, 454, {"metric": 7.0}, "metric revised"),
        (0.1, 424, 454, {"price": None}, "price revised"),
    ],
)
def test_problems(spark, theta, metric_to, price_to, change, want):
    old = [("a", day(i), float(i)) for i in range(-5, 1)]

    def now(name, last):
        rows = [*old, ("a", day(last), 1.0)]
        return series(spark, [(s, d, change[name]) if name in change and d == day(-2) else (s, d, v) for s, d, v in rows])

    ends = spark.createDataFrame([("a", Z, theta)], "series string, z date, theta double")
    got = confirm.forward_problems(ends, now("metric", metric_to), now("price", price_to), series(spark, old), series(spark, old))
    assert [(r["series"], r["problem"]) for r in got.collect()] == [("a", want)]


def test_nothing_now_and_nothing_before(spark):
    ends = spark.createDataFrame([("a", Z, 0.1)], "series string, z date, theta double")
    none = series(spark, [])
    assert confirm.forward_problems(ends, none, none, none, none).first()["problem"] == "metric ends early"
    assert confirm.forward_problems(ends.where("theta > 1"), none, none, none, none).count() == 0


def test_a_problem_gives_no_outcome(spark):
    df = spark.createDataFrame([(s, day(i), i % 2 == 0, float(i % 2 == 0)) for s in "ab" for i in range(1, 456)], "series string, d date, m boolean, r double")
    ends = spark.createDataFrame([("a", Z, 0.5), ("b", Z, 0.5)], "series string, z date, theta double")
    problems = spark.createDataFrame([("a", None), ("b", "price ends early")], "series string, problem string")
    got = {r["series"]: (r["problem"], r["outcome"]) for r in confirm.checked_forward(df, ends, problems, 0.01).collect()}
    assert got == {"a": (None, confirm.CONFIRMED), "b": ("price ends early", None)}


def test_what_lacks_a_field_is_no_template(spark):
    df = spark.createDataFrame([(1, 1, "x", "y"), (1, 2, "x", None), (1, 3, "x", "")], "by int, id int, f string, g string")
    full = rules.template_diff(df, df.where("id = 1"), ["f", "g"], "by")
    assert sorted((r["id"], r["same"], r["differ"]) for r in full.collect()) == [(1, True, ""), (2, False, "g"), (3, False, "g")]
    lacking = rules.template_diff(df.where("id = 2"), df.where("id = 2"), ["f", "g"], "by").first()
    assert (lacking["same"], lacking["differ"]) == (False, "")
    assert df.where("id = 2").select(rules.template_hash(["f", "g"]).alias("h")).where(F.col("h").isNotNull()).count() == 0
