import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewell.streaming import alarms, ticks


def test_alarms_once_through_restarts_late_and_revised_bars(spark, tmp_path):
    rng = np.random.default_rng(2)
    change = rng.normal(0, 0.01, (2, 200))
    change[0, [50, 51, 120, 199]] = [0.2, 0.3, -0.25, 0.4]
    start = dt.date(2020, 1, 1)
    rows = [(f"s{s}", start + dt.timedelta(i), float(c)) for s in (0, 1) for i, c in enumerate(100 * np.cumprod(1 + change[s]))]
    schema = "series string, d date, close double"
    df = spark.createDataFrame(rows, schema)
    want = sorted((r["series"], r["d"]) for r in alarms.alarms_of_table(df).collect())
    assert ("s0", start + dt.timedelta(51)) in want and ("s0", start + dt.timedelta(199)) in want
    place, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    day = F.date_diff("d", F.lit(start))
    again = df.where(day == 120)  # the alarm's own bar once more: no second alarm
    late = df.where(day == 60).withColumn("close", F.col("close") * 9)
    first = df.where(day == 121).withColumn("close", F.lit(1.0))  # a bar that is put right before the next one comes
    for part in (df.where(day < 121), again.union(late), first, df.where(day == 121), df.where(day > 121)):
        part.coalesce(1).write.mode("append").parquet(place)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place)
        ticks.appended(alarms.alarms(stream), out, check).awaitTermination()  # each time a new start
    got = sorted((r["series"], r["d"]) for r in spark.read.schema(alarms.OUT).parquet(out).collect())
    wrong = [(f"s{s}", start + dt.timedelta(121)) for s in (0, 1)]  # raised by the bars that were wrong
    assert got == sorted(set(want) | set(wrong))


def test_too_few_bars(spark):
    assert alarms.judged([1.0] * 30 + [9.0], 30) is None and alarms.judged([1.0, 1.1] * 15 + [9.0], 35) is not None
