import random
import re

import pytest

from tidewell.llm import batches, ngram_join
from tidewell.llm.components import components


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [{tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted([(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))], key=str)


def linked_rows(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [{tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set() for w in words]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    return [[j for j in range(len(rows)) if j != i and near(a, sets[j])] for i, a in enumerate(sets)]


def made_texts(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 6)))
    bases = [[word() for _ in range(rng.choice([3, 6, 20, 60, 200]))] for _ in range(14)]
    common = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            if w:
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w += common
        rows.append(((i * 7) % n, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(900, rows[3][1].upper()), rows[5], rows[5], (None, rows[9][1]), (None, "all alone here"), (901, None), (902, ""), (903, " \t"), (904, "x " * 300), (905, "x")]
    return rows


@pytest.mark.parametrize(("seed", "size", "block", "least"), [(1, 700, 3_000_000, 2000), (2, 4000, 600, 1), (3, 1 << 20, 40, 1)])
def test_against_brute_force_with_large_families_cut_into_blocks(spark, monkeypatch, seed, size, block, least):
    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAST", least)
    rows = made_texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.near_duplicates(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize(("size", "block", "least"), [(900, 3_000_000, 2000), (4000, 60, 1)])
def test_every_link_counts_and_classes_pair_once(spark, monkeypatch, size, block, least):
    monkeypatch.setattr(batches, "BATCH_BYTES", size)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LEAST", least)
    rows = [(n, t) for n, (_, t) in enumerate(made_texts(5))]
    want = linked_rows(rows)
    pairs, members = ngram_join.near_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    of = {r["doc_id"]: r for r in members.collect()}
    assert [of[i]["n_links"] for i, _ in rows] == [len(x) for x in want]
    found = sorted(map(tuple, pairs.collect()))
    assert found == sorted({(min(a, b), max(a, b)) for i, x in enumerate(want) for j in x if (a := of[i]["class"]) != (b := of[j]["class"])})
    pairs, members = ngram_join.near_pairs(spark.createDataFrame([], "doc_id long, text string"))
    assert pairs.count() == members.count() == 0


def test_one_of_each_group_stays_with_its_columns(spark):
    rows = made_texts(4)
    docs = spark.createDataFrame([(i, t, f"k{i}") for i, t in rows], "doc_id long, text string, key string").repartition(2)
    got = ngram_join.representatives(docs)
    assert got.columns == docs.columns
    want = {(c, n == 0) for i, n, c in brute(rows)}
    assert {(r["doc_id"], not re.search(r"[^\x20\x09-\x0D]", r["text"] or "")) for r in got.collect()} == want and got.count() == len(want)
    assert {r["text"] for r in got.where("doc_id = 901").collect()} == {None}
    assert ngram_join.representatives(docs.limit(0)).count() == 0
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100 + i, 150) for i in range(50)] + [(7, 7), (5, 6), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "x long, y long").repartition(5)).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in [*range(100, 151)]}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
