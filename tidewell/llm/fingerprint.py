"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, subtracted and peeled, all in DataFrame functions.

A text is cut into paragraphs at line ends; a paragraph is cut further into pieces of at most 160 code points. The
distinct pieces' 48-bit digests (a 32-bit hash and its 16-bit check) are dealt to BLOCKS-many tables, a power of two that
follows the number of pieces; each table has 3 parts of CELLS cells, and a digest is added to one cell of each part. A cell is
one long: 2^56 for each digest in it, plus the digests. The fingerprint lists the cells. Short texts are cut into shorter pieces
(PIECES) as well, so that their likeness has steps too, and the fingerprint lists those cells behind the first.

Two fingerprints are compared by the shortest pieces that both have: every text has those of 160, so any two texts can be compared.

Two fingerprints are compared by subtracting cells and peeling: a cell with one digest too many or too few gives that digest,
which then leaves its other cells, and so on, until the differing digests are known: differences() gives them. It is tried first on tables folded to
half their size and, where that fails, again on the whole ones (the larger try). A block that still fails differs by more than it can list; it counts as
wholly different (a whole block of either text has about 16 digests, and its 48 cells list some 35, so this is rare even for unrelated texts). Peeling finds at
most a digest a cell, so a block whose numbers of digests differ by more isn't tried. Likeness is shared digests by all digests: 1 for equal texts, near 0 for unrelated ones.

The work on a text grows with its length times the logarithm of it: digests are sorted once by block, blocks are slices of that.

Defined cases: a null text is an empty one; two texts without pieces are alike by 1; equal texts have equal fingerprints;
an edited text takes its end from the next larger doc_id (of several rows with it, the one whose text is smallest); rows that share an
id have the same next; null ids come first; a single document is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import stored

CELLS = 16  # of each of a block's three parts
PARTS = 3
PER_BLOCK = 16  # pieces of a block, at most on average
WEIGHT = 1 << 56
DIGEST = (1 << 48) - 1
ROUNDS = 8
EMPTY = "array<bigint>"
#: Code points of a piece at most, and below how many code points a text is cut so (None: always).
PIECES = ((160, None), (24, 1024), (8, 128))


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(value), f)[0]


def piece_sizes(text: Column) -> Column:
    """Code points of a piece at most, for each way the text is cut, longest pieces first."""
    n = F.length(text)
    return F.array_compact(F.array(*[F.lit(k) if below is None else F.when(n < below, k) for k, below in PIECES]))


def digests(text: Column, size: Column | int = PIECES[0][0]) -> Column:
    """Distinct 48-bit digests (above 0) of a text's pieces of at most size code points."""
    size = size if isinstance(size, Column) else F.lit(size)
    pieces = F.regexp_extract_all(text, F.concat(F.lit(r"[^\n]{1,"), size.cast("string"), F.lit("}")), F.lit(0))

    def digest(piece: Column) -> Column:
        high = F.shiftrightunsigned(F.xxhash64(piece), 32)
        return F.greatest(F.shiftleft(high, 16) + _check(high), F.lit(1))

    return F.array_distinct(F.transform(pieces, digest))


def _check(high: Column) -> Column:
    return F.pmod(F.xxhash64(high, F.lit(7)), F.lit(1 << 16))


def n_blocks(units: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.size(units) / PER_BLOCK, F.lit(1.0))))).cast("int")


def _spot(digest: Column, part: Column) -> Column:
    """Cell of a digest within a part, 0 to CELLS - 1: bits of its hash that don't choose the block."""
    return F.call_function("shiftrightunsigned", digest, (F.lit(16) + part * 5).cast("int")).bitwiseAND(F.lit(CELLS - 1))


def _block(digest: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(3)), blocks.cast("long")).cast("int")


def cells(units: Column) -> Column:
    """The table of digests: for each block, for each part, CELLS longs."""
    nothing = F.lit(0).cast("long")

    def block(own: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(PARTS * CELLS - 1)),
            lambda i: F.aggregate(own, nothing, lambda a, d: a + F.when(_spot(d, F.floor(i / CELLS)) == i % CELLS, d + F.lit(WEIGHT)).otherwise(nothing)),
        )

    def all_blocks(t: Column) -> Column:
        # a mark (digest 0) in front of each block, so that the marks' places are the blocks' starts
        keyed = F.transform(t["units"], lambda d: F.shiftleft(_block(d, t["blocks"]).cast("long"), 48) + d)
        marks = F.transform(F.sequence(F.lit(0), t["blocks"] - 1), lambda b: F.shiftleft(b.cast("long"), 48))
        return _let(F.sort_array(F.concat(keyed, marks)), lambda s: _let(F.struct(s.alias("s"), _marks(s).alias("starts")), lambda x: cut(x, t["blocks"])))

    def cut(x: Column, blocks: Column) -> Column:
        end = lambda b: F.coalesce(F.get(x["starts"], (b + 1).cast("int")), F.size(x["s"]))
        start = lambda b: F.get(x["starts"], b.cast("int"))
        own = lambda b: F.transform(F.slice(x["s"], start(b) + 2, end(b) - start(b) - 1), lambda d: d.bitwiseAND(F.lit(DIGEST)))
        return F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: _let(own(b), block)))

    return _let(_let(units, lambda u: F.struct(u.alias("units"), n_blocks(u).alias("blocks"))), all_blocks)


def _marks(s: Column) -> Column:
    """Places of the marks in the sorted keys."""
    return F.filter(F.transform(s, lambda d, i: F.when(d.bitwiseAND(F.lit(DIGEST)) == 0, i)), lambda i: i.isNotNull())


def tables(text: Column) -> Column:
    """A text's tables, one for each of piece_sizes()."""
    return F.transform(piece_sizes(text), lambda size: cells(digests(text, size)))


def as_string(made: Column) -> Column:
    """The fingerprint: cells in hexadecimal, an empty one by nothing, tables parted by ";"."""
    one = lambda table: F.concat_ws(",", F.transform(table, lambda c: F.when(c == 0, F.lit("")).otherwise(F.hex(c))))
    return F.concat_ws(";", F.transform(made, one))


def _blocks_of(table: Column) -> Column:
    return (F.size(table) / (PARTS * CELLS)).cast("int")


def _folded(table: Column, blocks: Column, k: Column) -> Column:
    """Block k of a table with fewer blocks: those that a digest may have been dealt to are added."""
    n = PARTS * CELLS
    added = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.aggregate(_parts_of(table, blocks, k), F.lit(0).cast("long"), lambda a, t: a + F.element_at(table, (t * n + i + 1).cast("int"))),
    )
    return F.when(_blocks_of(table) == blocks, F.slice(table, k * n + 1, n)).otherwise(added)


def _parts_of(table: Column, blocks: Column, k: Column) -> Column:
    """The blocks of a table that make up block k of one with fewer blocks."""
    return F.sequence(k, _blocks_of(table) - 1, blocks)


def _load(table: Column, blocks: Column, k: Column) -> Column:
    """Digests in block k of a table with fewer blocks, counted before cells are added: those of a long text wouldn't fit a long."""
    return F.aggregate(_parts_of(table, blocks, k), F.lit(0).cast("long"), lambda a, t: a + _loads(F.slice(table, (t * (PARTS * CELLS) + 1).cast("int"), CELLS)))


def _loads(part: Column) -> Column:
    """Digests in a block, from one part: each is in it once; negative counts stand below the others."""
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a + F.shiftright(c + F.lit(WEIGHT >> 1), 56))


def _peel(diff: Column, width: int) -> Column:
    """Digests that a block's cells differ by (d for one too many, -d - 1 for one too few), or null where peeling gets stuck. width: cells of a part."""
    start = F.struct(diff.alias("cells"), F.array().cast(EMPTY).alias("found"))

    def pure(cs: Column) -> Column:
        """Signed digests that stand alone in a cell: +d or -d."""
        found = F.transform(
            cs,
            lambda c, i: _let(
                F.abs(c) - F.lit(WEIGHT),
                lambda d: F.when(
                    (d >= 0)
                    & (d < F.lit(1 << 48))
                    & (_spot(d, F.floor(i / width)) % width == i % width)
                    & (_check(F.shiftrightunsigned(d, 16)) == d.bitwiseAND(F.lit(0xFFFF))),
                    F.when(c > 0, d).otherwise(-d - 1),
                ).otherwise(F.lit(None).cast("long")),
            ),
        )
        return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))

    def without(cs: Column, gone: Column) -> Column:
        def value(g: Column) -> Column:
            return F.when(g >= 0, g).otherwise(-g - 1)

        return F.transform(
            cs,
            lambda c, i: F.aggregate(
                gone,
                c,
                lambda a, g: a
                - F.when(
                    _spot(value(g), F.floor(i / width)) % width == i % width, F.when(g >= 0, g + F.lit(WEIGHT)).otherwise(g + 1 - F.lit(WEIGHT))
                ).otherwise(F.lit(0).cast("long")),
            ),
        )

    def step(acc: Column, _: Column) -> Column:
        go = lambda gone: F.when(F.size(gone) == 0, acc).otherwise(
            F.struct(without(acc["cells"], gone).alias("cells"), F.concat(acc["found"], gone).alias("found"))
        )
        done = ~F.exists(acc["cells"], lambda c: c != 0)
        return F.when(done, acc).otherwise(_let(pure(acc["cells"]), go))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.when(~F.exists(acc["cells"], lambda c: c != 0), acc["found"])
    )


def _differing(a: Column, b: Column) -> Column:
    """Digests that one block of both tables differs by (_peel()), or null where peeling gets stuck."""
    diff = F.zip_with(a, b, lambda x, y: x - y)
    half = F.transform(
        F.sequence(F.lit(0), F.lit(PARTS * CELLS // 2 - 1)),
        lambda i: _let(
            (F.floor(i / (CELLS // 2)) * CELLS + i % (CELLS // 2)).cast("int"),
            lambda k: F.element_at(diff, k + 1) + F.element_at(diff, k + CELLS // 2 + 1),
        ),
    )
    return _let(_peel(half, CELLS // 2), lambda found: F.when(found.isNotNull(), found).otherwise(_peel(diff, CELLS)))


def _block_counts(a: Column, b: Column, blocks: Column, k: Column) -> Column:
    """For block k of both tables: struct of digests in both together (all) and of differing ones (diff)."""

    def counts(load: Column) -> Column:
        both = load["a"] + load["b"]
        tried = _let(F.struct(_folded(a, blocks, k).alias("a"), _folded(b, blocks, k).alias("b")), lambda t: _differing(t["a"], t["b"]))
        found = F.when(F.abs(load["a"] - load["b"]) <= PARTS * CELLS, tried)
        return F.struct(both.alias("all"), _let(found, lambda x: F.when(x.isNotNull(), F.size(x).cast("long")).otherwise(both)).alias("diff"))

    return _let(F.struct(_load(a, blocks, k).alias("a"), _load(b, blocks, k).alias("b")), counts)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of the two tables' digests, from what peeling their difference recovers."""

    def compared(blocks: Column) -> Column:
        per = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: _block_counts(a, b, blocks, k))
        total = F.aggregate(
            per,
            F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("diff")),
            lambda s, p: F.struct((s["all"] + p["all"]).alias("all"), (s["diff"] + p["diff"]).alias("diff")),
        )
        return _let(total, lambda s: F.when(s["all"] + s["diff"] == 0, F.lit(1.0)).otherwise((s["all"] - s["diff"]) / (s["all"] + s["diff"])))

    return F.when(a == b, F.lit(1.0)).otherwise(_let(F.least(_blocks_of(a), _blocks_of(b)), compared))


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    """df with added, removed: digests that only table b, and only table a has, as far as peeling the tables' difference recovers them; stuck: blocks where it doesn't."""
    x, y, n = F.col(a), F.col(b), F.col("_n")

    def block(k: Column) -> Column:
        few = F.abs(_load(x, n, k) - _load(y, n, k)) <= PARTS * CELLS
        return F.when(few, _differing(_folded(x, n, k), _folded(y, n, k)))

    per = df.withColumn("_n", F.least(_blocks_of(x), _blocks_of(y))).withColumn("_per", F.transform(F.sequence(F.lit(0), n - 1), block))
    found = per.withColumns({"_all": F.flatten(F.filter("_per", lambda p: p.isNotNull())), "stuck": F.size(F.filter("_per", lambda p: p.isNull()))})
    added = F.transform(F.filter("_all", lambda d: d < 0), lambda d: -d - 1)
    return found.withColumns({"added": added, "removed": F.filter("_all", lambda d: d >= 0)}).drop("_n", "_per", "_all")


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two texts' tables by the shortest pieces that both are cut into."""
    pair = _let(F.least(F.size(a), F.size(b)), lambda k: F.struct(F.element_at(a, k).alias("a"), F.element_at(b, k).alias("b")))
    return _let(pair, lambda t: likeness(t["a"], t["b"]))


def neighbours(ids: DataFrame, buckets: int = 256) -> DataFrame:
    """ids (k, n: a row for each id) -> k, n_before: the n of the id before it in ascending order, and prev, that id; the first follows the last.

    Ids are dealt to ranges by approximate percentiles (a bounded list); each range is put in order by itself, and a table
    with a row for each range carries over its ends.
    """
    from pyspark.sql import Window as W

    edges = ids.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    edges = sorted({*edges})
    cuts = F.array(*[F.lit(e) for e in edges]).cast("array<bigint>")
    ranged = ids.withColumn("r", F.when(F.col("k").isNull(), F.lit(-1)).otherwise(F.size(F.filter(cuts, lambda e: e <= F.col("k")))))
    ends = ranged.groupBy("r").agg(F.max(F.struct("k", "n")).alias("last"))
    order = W.orderBy("r")
    tail = F.lag("last").over(order)
    wrapped = ends.select("r", F.coalesce(tail, F.last("last").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("carried"))
    inside = F.lag(F.struct("k", "n")).over(W.partitionBy("r").orderBy("k"))
    linked = ranged.withColumn("p", inside).join(F.broadcast(wrapped), "r")
    return linked.select("k", F.coalesce("p", "carried").alias("p")).select("k", F.col("p.k").alias("prev"), F.col("p.n").alias("n_before"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited (text), table, edited_table, next_table (each by piece size, arrays of cells)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = stored(text.select("doc_id", F.length("text").alias("n")).groupBy(F.col("doc_id").alias("k")).agg(F.max("n").alias("n")))
    before = stored(neighbours(ids))
    # both joins read one shuffle of the texts; tables are made behind it
    heads = (
        text.join(before, text["doc_id"].eqNullSafe(before["k"]))
        .select("prev", F.substring("text", F.lit(1), F.floor(F.col("n_before") / 4).cast("int")).alias("head"), tables(F.col("text")).alias("table"))
        .groupBy("prev")
        .agg(F.min(F.struct("head", "table")).alias("next"))
    )
    cut = F.floor(F.length("text") / 4).cast("int")
    joined = text.join(heads, text["doc_id"].eqNullSafe(heads["prev"]), "left")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next.head", F.lit(1), cut))
    return joined.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), tables(F.col("text")).alias("table"), F.col("next.table").alias("next_table")
    ).withColumn("edited_table", tables(F.col("edited")))


def compared(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("table")).alias("fingerprint"),
        as_string(F.col("edited_table")).alias("edited_fingerprint"),
        likeness_of(F.col("table"), F.col("edited_table")).alias("near_edited"),
        likeness_of(F.col("table"), F.col("next_table")).alias("near_next"),
    )


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_fingerprint": op8_fingerprint}
SQL: dict[str, str] = {}
