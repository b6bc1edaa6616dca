import hashlib
from collections import Counter

import numpy as np
import pytest

from tidewell.operators import draws


def pick(draw, item, n):
    return int(hashlib.md5(f"{draw}:{item}".encode()).hexdigest()[:7], 16) % n


@pytest.mark.parametrize("prefix", [b"0:", b"1999:", b"1" * 46 + b":"])  # up to 55 bytes: the length's own word is reached
def test_sevens_are_md5s(prefix):
    got = np.concatenate([draws.sevens(prefix, t) for t in draws.digits(0, 12) + draws.digits(9_999_990, 10_000_010)])
    items = [*range(12), *range(9_999_990, 10_000_010)]
    assert got.tolist() == [int(hashlib.md5(prefix + b"%d" % i).hexdigest()[:7], 16) for i in items]


@pytest.mark.parametrize("places", [None, 64])
def test_counts_are_those_of_all_picks(spark, monkeypatch, places):
    if places:  # levels in several pieces and parts, items in several blocks
        monkeypatch.setattr(draws, "PIECE", 32)
        monkeypatch.setattr(draws, "PLACES", places)
        monkeypatch.setattr(draws, "ITEMS", 50)
    sizes = {"a": 300, "b": 1, "c": 77}
    rows = [(level, i, n, (i * 7) % 256) for level, n in sizes.items() for i in range(n)]
    got = draws.stratified_counts(spark.createDataFrame(rows, "level string, i long, n long, cell int"), 19).collect()
    want = Counter((d, level, (pick(d, i, n) * 7) % 256) for d in range(19) for level, n in sizes.items() for i in range(n))
    assert {(r["draw"], r["level"], r["cell"]): r["count"] for r in got} == want
    assert len(got) == len(want)


def test_work_of_many_picks(spark):
    """60 million picks, none of which becomes a row."""
    import time

    cases = spark.range(30_000).selectExpr("'a' AS level", "id AS i", "30000L AS n", "CAST(id % 20 AS int) AS cell")
    began = time.time()
    assert draws.stratified_counts(cases, 2000).groupBy().sum("count").first()[0] == 60_000_000
    assert time.time() - began < 60


def test_a_cell_that_is_no_byte_fails(spark):
    with pytest.raises(Exception, match="0 to 255"):
        draws.stratified_counts(spark.createDataFrame([("a", 0, 1, 256)], "level string, i long, n long, cell int"), 1).collect()
