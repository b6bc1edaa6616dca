"""Alarms on new bars, once each: the last closes of a series are state, which a restart finds again.

A bar raises an alarm if its return exceeds MULTIPLE standard deviations of the last WINDOW returns (its own included) and is the largest in size of the
last RECENT; before WINDOW + RECENT returns a series raises none. A bar counts once its day is newer than the series' last one. A row for the last
day again is a revision: its close replaces the old one, and raises an alarm only if that day has had none. Rows of earlier days are late and change nothing.
Within a micro-batch rows are taken in order of days and closes, so that of several rows of one day the greatest close stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.functions import series as S
from tidewell.session import ship

MULTIPLE, WINDOW, RECENT = 3.0, 30, 5
OUT = "series string, d date, change double, threshold double"
STATE = "closes array<double>, n long, day date, told boolean"


def judged(closes: list[float], n: int) -> tuple[float, float] | None:
    """Change and threshold of the last close, if it raises an alarm. closes: the last WINDOW + 1 at most; n: returns so far."""
    if n < WINDOW + RECENT:
        return None
    x = np.array(closes)
    change = x[1:] / x[:-1] - 1
    threshold = MULTIPLE * change.std(ddof=1)
    size = np.abs(change)
    return (float(change[-1]), float(threshold)) if size[-1] > threshold and size[-1] >= size[-RECENT:].max() else None


def _taken(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    closes, n, day, told = state.get if state.exists else ([], 0, None, False)
    closes, found = list(closes), []
    rows = pd.concat(list(frames)).dropna(subset=["close"]).sort_values(["d", "close"])
    for d, close in zip(rows["d"], rows["close"], strict=True):
        if day is not None and d < day:
            continue
        if d == day:
            closes[-1] = close
        else:
            closes, n, day, told = [*closes[-WINDOW:], close], n + bool(closes), d, False
        if not told and (alarm := judged(closes, n)):
            found.append((key[0], d, *alarm))
            told = True
    if day is not None:
        state.update((closes, n, day, told))
    yield pd.DataFrame(found, columns=["series", "d", "change", "threshold"])


def alarms(bars: DataFrame) -> DataFrame:
    """series, d, change, threshold of a stream of bars (series, d, close): each alarm once."""
    ship(bars.sparkSession)
    return bars.select("series", "d", "close").groupBy("series").applyInPandasWithState(_taken, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def alarms_of_table(bars: DataFrame) -> DataFrame:
    """The same of a whole table, whose bars have come in order."""
    change = S.change(S.close())
    x = bars.select("series", "d", "close").withColumn("change", change).withColumn("size", F.abs("change"))
    x = x.withColumns({"threshold": S.guarded(F.stddev_samp, F.col("change"), WINDOW) * MULTIPLE, "n": F.count("change").over(S.so_far()), "most": F.max("size").over(S.trailing(RECENT))})
    return x.where((F.col("n") >= WINDOW + RECENT) & (F.col("size") > F.col("threshold")) & (F.col("size") >= F.col("most"))).select("series", "d", "change", "threshold")
