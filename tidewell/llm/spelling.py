"""Spelling variants: words one edit apart, by Levenshtein automata run against broadcast tries, and the chain of forms they lead to.

Words are counted in tasks (Arrow batches, map-side combination); what occurs LEAST times is the vocabulary. Its sorted words are cut into shards of
SHARD_BYTES, each a compact trie: nodes in breadth-first order, so that a node's children lie side by side; one character, one place and
one count a node. Shards are broadcast in rounds of ROUND_BYTES, whatever the vocabulary's size. A task takes its words through each shard: the
automaton of a word accepts what is one insertion, deletion or replacement away; its states are the position in the word and whether
the edit is spent. The walk is depth-first: along the word itself while the edit is left, and from each node on it through each child once
it is spent, where only the word's own rest is followed. Accepted words meet in the task: their number, and the most frequent one. Tasks give one row
a word and round, and Spark reduces these. Rounds times words are the whole work; nothing is paired by groups, so no group can be hot.

Forms follow each other up to a root by pointer jumping over the words that have one. A form is at least FACTOR times as frequent as its word, so a
chain has at most log(most frequent) links and few rounds of joins suffice.

Defined cases: a null or empty text has no words; bytes that are no UTF-8 end a run; a null doc_id stands as the empty string in the
sum; repeated rows count each; runs of any length count; other columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import hashing as H
from tidewell.session import bounded_batches, stored

LETTERS, LEAST, FACTOR, ONE_IN = 6, 5, 5, 199
SHARD_BYTES, ROUND_BYTES = 1 << 20, 64 << 20  # of words; of tries
HELD = 1_000_000  # distinct words that a task holds while it counts
LONG = 64  # bytes; longer runs are summed one by one

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & np.uint32(1), _CRC >> np.uint32(1) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))


# ---- words and their counts


def runs(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts and code points of the maximal runs of a-z and U+00C0 to U+00FF in lower-cased bytes."""
    rest = (low & 0xC0) == 0x80
    lead = low == 0xC3
    lead[at[1:][at[1:] > at[:-1]] - 1] = False
    lead[:-1] &= rest[1:]
    inside = (low >= 97) & (low <= 122) | lead
    inside[1:] |= lead[:-1]
    starts, ends, text = H.spans(inside.astype(np.uint8), at)
    wide = np.concatenate([[0], np.cumsum(lead)])
    return starts, ends, text, ends - starts - (wide[ends] - wide[starts])


def sums(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of spans, going on from the CRC-32 of what stands before each."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    s, c = starts[order], ~state[order].astype(np.uint32)
    many = np.searchsorted(-size[order], -np.arange(1, LONG + 1), side="right")  # spans that have an i-th byte
    for j, k in enumerate(many.tolist()):
        if not k:
            break
        c[:k] = _CRC[(c[:k] ^ low[s[:k] + j]) & 255] ^ c[:k] >> np.uint32(8)
    out = np.empty_like(c)
    out[order] = ~c
    for i in np.flatnonzero(size > LONG):
        out[i] = zlib.crc32(low[starts[i] : ends[i]].tobytes(), int(state[i]))
    return out


def words_of(doc_ids: list, texts: pa.Array, letters: int, one_in: int) -> Iterator[pa.Array]:
    """The words of texts, with their deletions."""
    for a, b, raw, at in H.chunks(texts, H.CHUNK_BYTES, 1 << 14):
        if not len(raw):
            continue
        low = H.lowered(raw)
        starts, ends, text, n = runs(low, at)
        may = n >= letters
        starts, ends, text, n = starts[may], ends[may], text[may], n[may]
        before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in doc_ids[a:b]], np.uint32)
        h = sums(low, starts, ends, before[text])
        cut = h % one_in == 0
        edge = np.zeros(len(low) + 1, np.int8)
        edge[starts[~cut]] += 1
        edge[ends[~cut]] -= 1
        offsets = np.zeros(int((~cut).sum()) + 1, np.int64)
        np.cumsum((ends - starts)[~cut], out=offsets[1:])
        data = low[np.cumsum(edge[:-1]) > 0]
        yield pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        less = []
        for s, e, k, size in zip(starts[cut], ends[cut], h[cut].tolist(), n[cut].tolist(), strict=True):
            if size > letters:
                w = low[s:e].tobytes().decode()
                less.append(w[: k % size] + w[k % size + 1 :])
        yield pa.array(less, pa.large_string())


def counts(docs: DataFrame, letters: int = LETTERS, one_in: int = ONE_IN, least: int = LEAST) -> DataFrame:
    """word, n: the words of docs (doc_id, text) that occur often enough."""
    bounded_batches(docs.sparkSession)

    def combined(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            found = pa.chunked_array([*words_of(batch.column(0).to_pylist(), batch.column(1), letters, one_in)], pa.large_string())
            own = pc.value_counts(found)
            held.append(pa.table({"word": own.field("values"), "n": own.field("counts").cast(pa.int64())}))
            if sum(len(t) for t in held) > HELD:
                held = [combined(held)]
                if len(held[0]) > HELD / 2:
                    yield from _batches(held.pop())
        if held:
            yield from _batches(combined(held))

    def _batches(t: pa.Table) -> list[pa.RecordBatch]:
        return t.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).to_batches(max_chunksize=20_000)

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(lambda x: H.tidied(work(x)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- tries and automata


class Trie:
    """labels[v]: the character that leads to node v; its children: first[v] to first[v + 1] - 1, in order; n[v]: the count of the word that ends there."""

    def __init__(self, words: list[str], n: list[int]):
        """words: sorted, distinct."""
        labels, first, count = ["\0"], array("I"), array("Q")
        level = [(0, len(words))]
        depth = 0
        while level:
            below = []
            for a, b in level:
                first.append(len(labels))
                ends = len(words[a]) == depth  # the shortest of them comes first
                count.append(n[a] if ends else 0)
                a += ends
                while a < b:
                    c, e = words[a][depth], a + 1
                    while e < b and words[e][depth] == c:
                        e += 1
                    labels.append(c)
                    below.append((a, e))
                    a = e
            level, depth = below, depth + 1
        first.append(len(labels))
        self.labels, self.first, self.n = "".join(labels), first, count


def accepted(word: str, trie: Trie) -> dict[str, int]:
    """The trie's words one edit from word, with their counts."""
    labels, first, count, find, out = trie.labels, trie.first, trie.n, trie.labels.find, {}
    node, size = 0, len(word)

    def spent(node: int, i: int) -> int:
        """Count of the word that the rest from position i leads to, the edit spent; 0 if none."""
        for c in word[i:]:
            node = find(c, first[node], first[node + 1])
            if node < 0:
                return 0
        return count[node]

    for i in range(size + 1):
        here = word[i] if i < size else ""
        after = word[i + 1] if i + 1 < size else ""
        if i < size and (not i or word[i - 1] != here) and (n := spent(node, i + 1)):
            out[word[:i] + word[i + 1 :]] = n  # of equal neighbours the first is deleted
        own = -1
        for k in range(first[node], first[node + 1]):
            c = labels[k]
            if c == here:
                own = k
                continue  # an insertion of the same character is found behind it
            a, b = first[k], first[k + 1]
            if here:
                if (find(after, a, b) >= 0 if after else count[k]) and (n := spent(k, i + 1)):
                    out[word[:i] + c + word[i + 1 :]] = n
                if find(here, a, b) >= 0 and (n := spent(k, i)):
                    out[word[:i] + c + word[i:]] = n
            elif n := count[k]:
                out[word + c] = n
        if own < 0:
            break
        node = own
    return out


def shards(words: DataFrame) -> DataFrame:
    """trie, size: the vocabulary as pickled tries, each of a range of words."""
    total = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[str, int]] = []
        size = 0

        def made() -> pd.DataFrame:
            blob = pickle.dumps(Trie([w for w, _ in held], [n for _, n in held]), protocol=5)
            return pd.DataFrame({"trie": [blob], "size": [len(blob)]})

        for pdf in frames:
            for w, n in zip(pdf["word"], pdf["n"], strict=True):
                held.append((w, n))
                size += len(w)
                if size >= SHARD_BYTES:
                    yield made()
                    held, size = [], 0
        if held:
            yield made()

    dealt = words.select("word", "n").repartitionByRange(max(1, math.ceil(total / SHARD_BYTES)), "word").sortWithinPartitions("word")
    return stored(dealt.mapInPandas(work, "trie binary, size long"))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (n, word): how many words of words (word, n) are one edit away, and the most frequent (ties: the smallest)."""
    spark = words.sparkSession
    tries = shards(words).withColumn("id", F.monotonically_increasing_id())
    rounds, room = [[]], ROUND_BYTES
    for r in tries.select("id", "size").collect():  # two numbers for each SHARD_BYTES of words
        if rounds[-1] and room < r["size"]:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(r["id"])
        room -= r["size"]
    dealt = stored(words.select("word", "n").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word"))
    found = None
    for own in rounds:
        sent = spark.sparkContext.broadcast([bytes(r["trie"]) for r in tries.where(F.col("id").isin(own)).select("trie").collect()])

        def work(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            loaded = [pickle.loads(x) for x in sent.value]
            for pdf in frames:
                many, best = [], []
                for w in pdf["word"]:
                    k, top = 0, (0, "")
                    for trie in loaded:
                        if near := accepted(w, trie):
                            k += len(near)
                            for x, n in near.items():
                                if n > top[0] or n == top[0] and x < top[1]:
                                    top = n, x
                    many.append(k)
                    best.append(top if k else (None, None))
                yield pd.DataFrame({"word": pdf["word"], "n": pdf["n"], "n_near": many, "best_n": pd.array([n for n, _ in best], "Int64"), "best": [x for _, x in best]})

        one = stored(dealt.mapInPandas(work, "word string, n long, n_near long, best_n long, best string"))
        sent.destroy()
        found = one if found is None else found.union(one)
    order = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    merged = found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), order.alias("b"))
    return merged.select("word", "n", "n_near", F.struct((-F.col("b.less")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def roots(forms: DataFrame, most: int, factor: int = FACTOR) -> DataFrame:
    """word, root of forms (word, form): where the chain of forms ends. most: the largest count, which bounds a chain."""
    found, links = forms.select("word", F.col("form").alias("root")), 1
    longest = math.log(max(most, 2), factor) + 1
    while links < longest:
        found = stored(found)
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found, links = found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), 2 * links
    return found


def variants(docs: DataFrame, letters: int = LETTERS, least: int = LEAST, factor: int = FACTOR, one_in: int = ONE_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text)."""
    words = stored(counts(docs, letters, one_in, least))
    most = words.agg(F.max("n")).first()[0]
    near = neighbours(words)
    has = F.col("best.n") >= factor * F.col("n")
    near = stored(near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", "n_near", F.when(has, F.col("best.n")).alias("form_n")))
    found = near.join(roots(near.where("form IS NOT NULL"), most or 0, factor), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
# CRC-32 goes a byte a step over all distinct runs at once; neighbours meet on what is left when one of them, or both at one place, lose a code point.
SQL = {
    "op11_spelling_variants": f"""
WITH RECURSIVE b(k, i, v) AS (SELECT k, 0, k FROM range(256) t(k) UNION ALL SELECT k, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM b WHERE i < 8),
crc AS (SELECT k, v FROM b WHERE i = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LETTERS} GROUP BY ALL)),
told AS (SELECT id, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM own),
c(id, h, i, v) AS (
  SELECT id, h, 0::BIGINT, 4294967295 FROM told
  UNION ALL SELECT id, h, i + 1, xor(c.v // 256, crc.v) FROM c JOIN crc ON crc.k = xor(c.v % 256, ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT) WHERE i < length(h) // 2),
cut AS (SELECT id, 4294967295 - v AS v FROM c WHERE i = length(h) // 2),
w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN v % {ONE_IN} = 0 THEN substr(run, 1, (v % length(run))::BIGINT) || substr(run, (v % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM own JOIN cut USING (id))
  WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {LEAST}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FACTOR} * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
g AS (SELECT f.*, (SELECT min(other) FROM near WHERE near.word = f.word AND near.m = f.form_n) AS form FROM f),
r(word, at_word) AS (SELECT word, word FROM g UNION ALL SELECT r.word, g.form FROM r JOIN g ON g.word = r.at_word WHERE g.form IS NOT NULL)
SELECT g.word, g.form, r.at_word AS root, g.n, g.n_near, g.form_n FROM g JOIN r ON r.word = g.word JOIN g e ON e.word = r.at_word WHERE e.form IS NULL
"""
}
