import collections
import re
import zlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import spelling as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, letters=S.LETTERS, least=S.LEAST, one_in=S.ONE_IN):
    c = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= letters:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= least}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(c, factor=S.FACTOR):
    near = {w: [x for x in c if one_edit(w, x)] for w in c}
    form = {w: min(near[w], key=lambda x: (-c[x], x)) if near[w] else None for w in c}
    form = {w: x if x and c[x] >= factor * c[w] else None for w, x in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), c.get(form[w], -1)) for w, n in c.items())


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit("y"), "root": F.lit(0)})
    got = S.variants(df, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], r[5] or -1) for r in got.collect())


FAMILY = {"straße": 1, "strasse": 9, "strase": 2, "colour": 40, "color": 3, "colours": 8, "coloürs": 1, "abcdef": 125, "abcdeg": 25, "abcdgg": 5, "abcggg": 1, "aaaaaa": 6, "aaaaaaa": 1, "aaaaaaaa": 30, "éèàéèà": 5, "éèàéè": 25}


def test_against_brute_force(spark, monkeypatch):
    rows = [(i, " ".join(f"{w.upper() if i % 2 else w}{'×' if i == 3 else '.'}" for w in FAMILY for _ in range(FAMILY[w]))) for i in range(12)]
    rows += [(None, "Colour colour null"), (5, None), (6, ""), (7, "a" * 300 + " " + "É" * 200), (7, "a" * 300), *[(8, "xÃ éĀé abcdef́abc")] * 3]
    want = brute(counted(rows, letters=4, least=2, one_in=3))
    assert run(spark, rows, letters=4, least=2, one_in=3) == want
    assert any(x[1] for x in want)
    monkeypatch.setattr(S, "SHARD_BYTES", 40)  # many shards, several rounds, counts that are handed on early
    monkeypatch.setattr(S, "ROUND_BYTES", 2000)
    monkeypatch.setattr(S, "HELD", 3)
    assert run(spark, rows, letters=4, least=2, one_in=3) == want
    assert run(spark, rows) == brute(counted(rows))


def test_long_chain(spark):
    words = [f"{'b' * k}{'a' * (9 - k)}" for k in range(7)]  # each one replacement from the next
    df = spark.createDataFrame([(w, f) for w, f in zip(words, words[1:])], "word string, form string")
    assert {tuple(r) for r in S.roots(df, 5**8).collect()} == {(w, words[-1]) for w in words[:-1]}


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "a b c")]) == []


@given(st.sets(st.text("abé", min_size=1, max_size=6), min_size=1), st.text("abé", min_size=1, max_size=6))
def test_automaton_accepts_one_edit(words, word):
    words = sorted(words)
    trie = S.Trie(words, [*range(1, len(words) + 1)])
    assert S.accepted(word, trie) == {x: n for n, x in enumerate(words, 1) if one_edit(word, x)}


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(S.SQL["op11_spelling_variants"]).project("word, form, root, n, n_near, form_n").fetchall()
    got = S.op11_spelling_variants(spark, "/root/testdata/sf0.001").collect()
    assert len(want) > 500 and sorted(map(str, map(tuple, got))) == sorted(map(str, want))
