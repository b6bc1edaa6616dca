"""Resamples within levels, counted by cell: no pick becomes a row.

A pick is the md5 of "draw:item", its first 7 digits, modulo the level's size (as curves.picked()). It is the same number for every level, so it is
worked out once for all of them, in blocks of items by NumPy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import ship, stored

#: Draws of a task, items hashed at once, places of a packed piece, and places of a level that one task holds (a byte each).
DRAWS, ITEMS, PIECE, PLACES = 16, 1 << 14, 1 << 16, 1 << 24

_K = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURN = [s for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in turns]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def digits(first: int, last: int) -> list[np.ndarray]:
    """The items from first to below last in ASCII, a matrix for each length."""
    out = []
    while first < last:
        width = len(str(first))
        upto = min(last, 10**width)
        out.append((np.arange(first, upto)[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8))
        first = upto
    return out


def sevens(prefix: bytes, items: np.ndarray) -> np.ndarray:
    """The first 7 hexadecimal digits of md5(prefix + item) as numbers; items as by digits(), at most 55 bytes in all."""
    n, size = len(items), len(prefix) + items.shape[1]
    text = np.zeros((n, size // 4 * 4 + 4), np.uint8)
    text[:, : len(prefix)], text[:, len(prefix) : size], text[:, size] = np.frombuffer(prefix, np.uint8), items, 128
    words = dict(enumerate(np.ascontiguousarray(text.view("<u4").T)))
    words[14] = np.uint32(8 * size) + words[14] if 14 in words else np.uint32(8 * size)
    a, b, c, d = (np.full(n, x) for x in _START)
    for i, (k, turn) in enumerate(zip(_K, _TURN, strict=True)):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        f += k
        if at in words:
            f += words[at]
        a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
    return (a + _START[0]).byteswap() >> np.uint32(4)


def stratified_counts(cases: DataFrame, draws: int) -> DataFrame:
    """cases: level, i (0 to n - 1 within the level), n, cell (0 to 255). draw, level, cell, count of as many picks of a level as it has, with replacement.

    Cells are packed, a byte a place, and dealt with 16 draws at a time over the cluster; a level of more than PLACES places is dealt in several parts,
    each of which counts the picks that fall into it.
    """
    ship(cases.sparkSession)
    kind = cases.schema["level"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        if not pdf["cell"].between(0, 255).all():
            raise ValueError("cells are numbers from 0 to 255")
        return pd.DataFrame({"level": pdf["level"].iloc[:1], "n": pdf["n"].iloc[:1], "first": pdf["i"].iloc[:1], "cells": [pdf["cell"].to_numpy(np.uint8).tobytes()]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = []
        for (level, n), rows in pdf.sort_values("first").groupby(["level", "n"], sort=False):
            levels.append((level, n, rows["first"].iloc[0], np.frombuffer(b"".join(rows["cells"]), np.uint8)))
        mine = range(pdf["chunk"].iloc[0] * DRAWS, min(draws, (pdf["chunk"].iloc[0] + 1) * DRAWS))
        found = np.zeros((len(mine), len(levels), 256), np.int64)
        most = max(n for _, n, _, _ in levels)
        for begun in range(0, most, ITEMS):
            texts = digits(begun, min(most, begun + ITEMS))
            for k, draw in enumerate(mine):
                hashes = np.concatenate([sevens(b"%d:" % draw, t) for t in texts])
                for j, (_, n, first, cells) in enumerate(levels):
                    own = hashes[: max(0, n - begun)]
                    at = (own - own // np.uint32(n) * np.uint32(n)).astype(np.int64) - first
                    if len(cells) < n:
                        at = at[(at >= 0) & (at < len(cells))]
                    found[k, j] += np.bincount(cells[at], minlength=256)
        k, j, cell = found.nonzero()
        return pd.DataFrame({"draw": k + mine.start, "level": [levels[x][0] for x in j], "cell": cell, "count": found[k, j, cell]})

    chunks = -(-draws // DRAWS)
    typed = cases.select("level", F.col("i").cast("long").alias("i"), F.col("n").cast("long").alias("n"), F.col("cell").cast("int").alias("cell"), F.floor(F.col("i") / PIECE).alias("piece"))
    packed = stored(typed.groupBy("level", "piece").applyInPandas(pack, f"level {kind}, n long, first long, cells binary"))
    dealt = packed.select("*", F.floor(F.col("first") / PLACES).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    each = dealt.repartition(chunks, "chunk", "part").groupBy("chunk", "part").applyInPandas(count, f"draw int, level {kind}, cell int, count long")
    return each.groupBy("draw", "level", "cell").agg(F.sum("count").alias("count"))
