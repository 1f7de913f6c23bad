import random

import numpy as np
import pytest

from quarry.llm import minhash as M
from quarry.llm.graph import components

from .helpers import ODD, documents, words


def sets(text):
    return M.weighted(M.shingles(M.hasher()(M.WORDS.findall((text or "").lower()))))


def brute(rows, threshold=0.8):
    """Class per row, by all pairs."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(M.WORDS.findall((t or "").lower()), sets(t)) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = known[i][0] == known[j][0] or (len(known[i][1][0]) and len(known[j][1][0]) and M.similarity(known[i][1], known[j][1]) >= threshold)
            if same:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, (True, 0)), (d is None, d or 0))
    return sorted(((rows[i][0], None if low[find(i)][0] else low[find(i)][1]) for i in range(len(rows))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in df.collect()), key=repr)


def test_agreement_is_weighted_similarity():
    rng = np.random.default_rng(3)
    e = np.unique(rng.integers(0, 2**62, 300).astype(np.uint64))
    a, b = (e[:200], rng.integers(1, 5, 200).astype(float)), (e[80:280], rng.integers(1, 5, 200).astype(float))
    s = M.signatures([a, b], 4000)
    assert abs((s[0] == s[1]).mean() - M.similarity(a, b)) < 0.035
    real = M.signatures([(e[:1], np.array([2.5])), (e[:1], np.array([1.0]))], 4000)
    assert abs((real[0] == real[1]).mean() - 0.4) < 0.035


def test_every_coordinate_is_filled():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5000):
        s = M.signatures([(np.unique(rng.integers(0, 2**62, n).astype(np.uint64)), np.ones(n))], 180)
        assert (s != np.iinfo(np.uint64).max).all()


def test_odd_rows(spark):
    assert got(M.classes(documents(spark, ODD))) == brute(ODD)


def test_empty_table(spark):
    assert M.classes(documents(spark, [])).count() == 0 and M.keep_one(documents(spark, [])).count() == 0


def test_classes_equal_all_pairs(spark):
    """A large group of copies of one text, copies of copies, texts that share a passage, and others."""
    rng = random.Random(5)
    base, passage = words(rng, 150), words(rng, 40)

    def changed(source, k):
        out = list(source)
        for p in rng.sample(range(len(out)), k):
            out[p] = f"x{rng.randrange(10**6)}"
        return out

    texts = [base] + [changed(base, rng.choice((0, 1, 2, 3, 5, 8))) for _ in range(60)]
    texts += [changed(rng.choice(texts), 2) for _ in range(20)]
    texts += [words(rng, 60) + passage for _ in range(15)]
    texts += [words(rng, rng.choice((1, 3, 4, 5, 6, 40))) for _ in range(40)]
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = documents(spark, rows)
    assert got(M.classes(docs)) == brute(rows)
    kept = sorted(r.doc_id for r in M.keep_one(docs).collect())
    assert kept == sorted({c for _, c in brute(rows)})


def test_hot_bucket_in_cells(spark, monkeypatch):
    """Texts that share a passage and resemble their hub by little more than half, in a grid of many cells: the same classes."""
    rng = random.Random(9)
    shared, rows = words(rng, 200), []
    for k in range(25):
        own = shared + words(rng, 90)
        rows += [(100 * k + j, " ".join(own[:-j] + [f"y{j}"] * j if j else own)) for j in range(2)]
    docs = documents(spark, rows)
    want = got(M.classes(docs))
    assert want == brute(rows)
    monkeypatch.setattr(M, "CELL", 20)
    assert got(M.classes(docs)) == want


def test_without_broadcasts(spark, monkeypatch):
    """Beyond the bound of every broadcast: filters and shuffled joins give the same."""
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    rng = random.Random(3)
    base = [words(rng, 80) for _ in range(6)]
    rows = [(200 + i, " ".join([*base[i % 6][: 80 - i // 12], *(["new"] * (i // 12))])) for i in range(48)] + [(100 + i, " ".join(words(rng, 30))) for i in range(20)] + ODD
    docs = documents(spark, rows)
    assert got(M.classes(docs)) == brute(rows)
    kept = M.keep_one(docs.withColumnRenamed("lang", "node"))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, c in brute(rows)}, key=repr)


def test_recall_against_all_pairs_of_documents(spark):
    """Every pair of sf0.01's documents at 0.8 or more, found by an inverted index of five-word runs, is in one class."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, M.WORDS.findall((r.text or "").lower())) for r in docs.select("doc_id", "text").collect()]
    bags = {i: Counter(tuple(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))) if w else Counter() for i, w in rows}
    holders, common = defaultdict(list), Counter()
    for i, bag in bags.items():
        for g in bag:
            holders[g].append(i)
    for g, ids in holders.items():
        for x in range(len(ids)):
            for y in range(x):
                common[ids[y], ids[x]] += min(bags[ids[x]][g], bags[ids[y]][g])
    size = {i: sum(b.values()) for i, b in bags.items()}
    pairs = {p for p, c in common.items() if c / (size[p[0]] + size[p[1]] - c) >= 0.8}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    same = {r.doc_id: r.class_id for r in M.classes(docs).collect()}
    assert len(pairs) > 30 and sum(same[a] == same[b] for a, b in pairs) >= 0.999 * len(pairs)
    empty = [i for i, w in rows if not w]
    assert {i: c for i, c in same.items() if i not in empty} == {i: find(i) for i, _ in rows if i not in empty}


def test_keep_one_keeps_columns(spark):
    docs = documents(spark, ODD).withColumnRenamed("lang", "node").withColumnRenamed("source", "_id")
    kept = M.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 4, 6, 7]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(31)} | {i: 100 for i in (100, 101, 102)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_do_not_stop_early(spark, monkeypatch):
    from quarry.llm import graph

    monkeypatch.setattr(graph, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long"))
