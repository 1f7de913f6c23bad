"""Decontamination, mixing, token counts and the pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontam, exact, minhash, mixing, queries, tokens, toxicity

from .helpers import ODD, documents, words

SF = "/root/testdata/sf0.001"


def test_search_equals_scoring_all_items():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, rng.randrange(4, 40), 150))) for i in range(200)]
    for threshold in (0.1, 0.4, 0.7):
        index = decontam.Index(items, threshold, 0.8, 64)
        for _ in range(150):
            terms = sorted({index.terms[w] for w in words(rng, 40, 150) + decontam.words_of(rng.choice(items)[1]) if w in index.terms})
            scores = np.zeros(len(index.ids))
            for t in terms:
                for d, s in zip(index.docs[t], index.shares[t], strict=True):
                    scores[d] += s
            assert sorted(index.search(terms)) == np.flatnonzero(scores >= threshold - 1e-9).tolist()


def brute_leaks(rows, items, threshold=0.7, overlap=0.8, passage=128):
    """Every passage against every item."""
    index = decontam.Index(items, threshold, overlap, passage)
    step, out = index.passage // 2, set()
    for i, t in rows:
        w = decontam.words_of(t or "")
        for at in range(0, max(1, len(w)), step):
            have = {index.terms[x] for x in w[at : at + index.passage] if x in index.terms}
            for d in range(len(index.ids)):
                if sum(s for x in have for k, s in zip(index.docs[x], index.shares[x], strict=True) if k == d) >= threshold - 1e-9:
                    if all(len(g & decontam.grams(w, min(5, len(p)))) / len(g) >= overlap for p, g in index.parts[d]):
                        out.add((i, index.ids[d]))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(8, 60), 300)) + ". " + " ".join(words(rng, 6, 300)) + ".") for i in range(40)]
    items += [(100, "one sentence of nine words stands here quite alone"), (101, None), (102, ""), (None, items[0][1])]
    rows = []
    for i in range(120):
        w = words(rng, rng.choice((0, 20, 200, 900)), 300)
        for _ in range(rng.choice((0, 0, 1, 2))):
            inside = decontam.words_of(rng.choice(items[:41])[1])
            if rng.random() < 0.4:
                inside[rng.randrange(len(inside))] = "zz"
            at = rng.randrange(len(w) + 1)
            w[at:at] = inside
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(ODD)]
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs.withColumn("item_id", F.lit(1)), benchmark).collect()}
    assert got == brute_leaks(rows, [(i, t or "") for i, t in items]) and got
    clean = decontam.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_leaks_in_parts_and_empty(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, 30, 500))) for i in range(25)]
    docs = documents(spark, [(i, " ".join(words(rng, 50, 500)) + " " + items[i][1]) for i in range(25)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEMS", 7)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == {(i, i) for i in range(25)}
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), benchmark).count() == 0
    assert decontam.without_leaks(docs, benchmark.limit(0)).count() == 25


def test_one_part_at_a_time(spark, monkeypatch):
    """Of 50 parts one is on the executors at a time; a very long item does not stretch the passages of the others."""
    rng = random.Random(10)
    items = [(i, " ".join(words(rng, 30, 900))) for i in range(50)]
    rows = [(i, " ".join(words(rng, 50, 900)) + " " + items[i][1]) for i in range(0, 50, 2)]
    docs, benchmark = documents(spark, rows).coalesce(2), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEMS", 1)
    live, most, send = set(), [0], spark.sparkContext.broadcast

    def counted(value):
        shared = send(value)
        if isinstance(value, decontam.Index):
            live.add(id(shared))
            most[0] = max(most[0], len(live))
            monkeypatch.setattr(shared, "destroy", lambda f=shared.destroy, k=id(shared): (live.discard(k), f()))
        return shared

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == {(i, i) for i, _ in rows}
    assert decontam.without_leaks(docs, benchmark).count() == 0 and most[0] == 1 and not live
    monkeypatch.undo()
    long = spark.createDataFrame([*items, (99, " ".join(words(rng, 20_000, 900)))], benchmark.schema)
    assert sorted(len(p.ids) for p in decontam.index_parts(long)) == [1, 50]
    assert min(p.passage for p in decontam.index_parts(long)) == 128


def test_edited_leaks(spark, tmp_path):
    """One word replaced within a short answer, and one left out; shuffled words and a lone question are no leak."""
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 14, 3000)) + ". " + " ".join(words(rng, 7, 3000)) + ".") for i in range(30)]
    own = [decontam.words_of(t) for _, t in items]
    around = words(rng, 100, 3000)
    rows = []
    for i, w in enumerate(own):
        rows.append((i, " ".join([*around, *w[:17], "zz", *w[18:], *around])))
        rows.append((100 + i, " ".join([*w[:10], *w[11:]])))
        rows.append((200 + i, " ".join([*around, *rng.sample(w, len(w))])))
        rows.append((300 + i, " ".join([*around, *w[:14], *around])))
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {(k + i, i) for i in range(30) for k in (0, 100)}
    assert {(r.doc_id, r.item_id) for r in queries.op8_decontaminate(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()} == {k + i for i in range(30) for k in (200, 300)}


def test_targets():
    assert mixing.targets([("a", 100), ("b", 100), ("c", 100)]) == pytest.approx([200, 83.3333333, 166.6666667])
    assert mixing.targets([("a", 10), ("b", 1000)]) == pytest.approx([20, 1495])
    assert mixing.targets([("a", 0), ("b", 0)]) == [0, 0]


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        p = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(p) == list(range(n))
    p = mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1))
    assert (p != np.arange(1000)).mean() > 0.9 and (p != mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).mean() > 0.9


def test_mixture_is_what_taken_says(spark):
    """Taken words are those of the blocks that the slots read, counted from the mixture itself."""
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.choice((0, 1, 10, 100, 700)))), rng.choice(["a", "b", "c", None])) for i in range(300)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in mixing.taken_words(docs, block=16).collect()}
    taken = Counter()
    for r in mixing.mixed(docs, block=16).collect():
        for p in r.parts:
            taken[p.doc_id] += p.words
    sources, sizes = defaultdict(int), {i: len(t.split()) for i, t, _ in rows}
    for i, _, s in rows:
        sources[s] += sizes[i]
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    aims = dict(zip(order, mixing.targets([(s, sources[s]) for s in order]), strict=True))
    took = defaultdict(int)
    for i, _, s in rows:
        assert got[i].taken == taken[i] <= 2 * sizes[i] and got[i].size == sizes[i]
        assert got[i].source_size == sources[s] and got[i].target == pytest.approx(aims[s])
        took[s] += taken[i]
    assert all(abs(took[s] - aims[s]) <= 0.02 * aims[s] + 16 for s in took)
    assert {r.doc_id: r.taken for r in mixing.taken_words(docs, block=16).collect()} == {i: r.taken for i, r in got.items()}


def scalar_permuted(i, n, key):
    """The permutation by whole numbers, one index at a time."""
    mask64, half = (1 << 64) - 1, 1
    while 4**half < n:
        half += 1
    while True:
        left, right = i >> half, i & ((1 << half) - 1)
        for r in range(4):
            f = (right + key + r) * 0x9E3779B97F4A7C15 & mask64
            f = (f ^ (f >> 29)) * 0xBF58476D1CE4E5B9 & mask64
            left, right = right, left ^ ((f >> 32) & ((1 << half) - 1))
        i = left << half | right
        if i < n:
            return i


def test_mixture_equals_a_plain_version(spark):
    """Streams, blocks, draws and permutations made one word, one shard and one slot at a time."""
    xxhash = pytest.importorskip("xxhash")
    rng, block, slots, seed = random.Random(15), 8, 32, 7
    rows = [(i, " ".join(words(rng, rng.choice((0, 1, 9, 80)))), rng.choice(["a", "b", "c", "c", "c"])) for i in range(400)]
    got = {r.doc_id: r for r in mixing.taken_words(documents(spark, rows), block=block, slots=slots).collect()}

    def at(i):  # two 64-bit hashes chained, the second of an int
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed=42)
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), seed=h)
        return h - 2**64 if h >= 2**63 else h

    sizes = {i: len(t.split()) for i, t, _ in rows}
    names = sorted({s for *_, s in rows})
    streams = {s: [i for *_, i in sorted((at(i) % 256, at(i), i) for i, _, x in rows if x == s) for _ in range(sizes[i])] for s in names}
    aims = mixing.targets([(s, len(streams[s])) for s in names])
    blocks = [-(-len(streams[s]) // block) for s in names]
    quota = [min(round(t / len(streams[s]) * b), 2 * b) for s, t, b in zip(names, aims, blocks, strict=True)]
    taken, total, given = Counter(), sum(quota), [0] * len(names)

    def deal(a, b, mine):
        """The counts of the shards from a to b, by recursion over whole lists."""
        if b - a == 1:
            return [mine]
        m, out, g = (a + b) // 2, [0] * len(mine), np.random.default_rng([seed, a, b])
        while sum(out) < (m - a) * slots:
            rest = np.array([q - o for q, o in zip(mine, out, strict=True)])
            more = g.multinomial((m - a) * slots - sum(out), rest / rest.sum())
            out = [o + min(int(x), int(r)) for o, x, r in zip(out, more, rest, strict=True)]
        return deal(a, m, out) + deal(m, b, [q - o for q, o in zip(mine, out, strict=True)])

    dealt = deal(0, -(-total // slots), quota)
    assert [sum(d) for d in dealt[:-1]] == [slots] * (len(dealt) - 1) and 0 < sum(dealt[-1]) <= slots
    for counts in dealt:
        for k, n in enumerate(counts):
            for slot in range(given[k], given[k] + n):
                b = scalar_permuted(slot % blocks[k], blocks[k], seed * 1000003 + k + slot // blocks[k] * 7919)
                taken.update(streams[names[k]][b * block : (b + 1) * block])
            given[k] += n
    assert given == quota
    assert {i: got[i].taken for i in sizes} == {i: taken[i] for i in sizes}


def test_shards_are_walked_alike_from_anywhere():
    quota = np.array([5_000_000_000_000, 3, 0, 700_000_000_000])
    shards = -(-int(quota.sum()) // mixing.SLOTS)
    one = list(mixing.shard_counts(quota, shards - 2, shards, 3))
    two = [x for k in (shards - 2, shards - 1) for x in mixing.shard_counts(quota, k, k + 1, 3)]
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(one, two, strict=True))
    assert (one[-1][1] + one[-1][2] == quota).all() and one[0][2].sum() == mixing.SLOTS and len(one) == 2


def test_null_ids_are_spread(spark):
    docs = documents(spark, [(None, "a b c") for _ in range(2000)])
    rows, _ = mixing.mixture(docs)
    assert rows.select("piece").distinct().count() > 200 and rows.select("start").distinct().count() == 2000
    assert mixing.taken_words(docs).agg(F.sum("taken")).first()[0] == pytest.approx(9000, abs=200)


def test_mixing_odd_rows(spark):
    out = mixing.taken_words(documents(spark, ODD).withColumn("start", F.lit(1)))
    assert out.count() == len(ODD) and out.filter("taken > 2 * size").count() == 0
    assert mixing.taken_words(documents(spark, [])).count() == 0
    assert mixing.taken_words(documents(spark, [(1, ""), (2, None)])).filter("taken = 0").count() == 2


TRICKY = ["<|endoftext|> a<|startoftext|>b", "it's 's é ́x", " x y\x1cz \x85 q", "  \n\n ", "ΑΣ ΣΑΣ", "don't'll 12 34 ½ ||| <| endoftext|>", "한국어 ㅎ ㅏ ᄒ ᅡ", "a\tb\r\nc d", "word " * 30000, "x" * 30000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_equal_the_library(spark, name):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path(name))
    texts = TRICKY + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()] + [t for _, t in ODD]
    docs = documents(spark, list(enumerate(texts)))
    cut = "space" if name.startswith("word") else "before_space"
    got = {r.doc_id: r for r in tokens.token_counts(docs.withColumn("n_tokens", F.lit("x")), P.path(name), cut=cut).collect()}
    for i, t in enumerate(texts):
        want = len(model.encode(t or "", add_special_tokens=False))
        assert got[i].n_tokens == want, t
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want > 2048)


def test_counter_forgets(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    with open(P.path("word_bpe_49k.json")) as f:
        counter = tokens.Counter(f.read(), "space", 256)
    rng = random.Random(1)
    texts = [" ".join(words(rng, 40, 300)) for _ in range(50)]
    once = [n for t in texts for n in counter.count([t])]
    assert once == counter.count(texts) and len(counter.known) <= 300


def test_sentencepiece_counts(spark):
    P = pytest.importorskip("public_tokenizers")
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["hello world", "", "a  b"]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(documents(spark, list(enumerate(texts))), P.path("piece_bpe_32k.model"), cut="none").collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_pipeline_stages(spark):
    """Each stage against a plain form of it, on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        before = {r.doc_id: r.text for r in docs.collect()}
        if k == len(corpus_pipeline.STAGES) - 1:
            assert out.count() == len(before)
            break
        assert out.columns == names
        after = {r.doc_id for r in out.collect()}
        if k == 0:
            want = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).filter("predicted = 0").collect()}
        elif k == 1:
            seen, want = set(), set()
            for i in sorted(before):
                if (t := __import__("re").sub(r"[\x20\x09-\x0D]+", " ", before[i])) not in seen:
                    seen.add(t)
                    want.add(i)
        elif k == 2:
            want = {r.class_id for r in minhash.classes(docs).collect()}
        else:
            leaks = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            want = set(before) - leaks
        assert after == want
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == len(before)
    assert exact.decisions(docs).filter("not kept").count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    rows = ODD + [(50, "benchmark passage text of several words that must leave here now. It does.")]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), *[(i, 0, 0) for i in range(2, 30)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, rows[-1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = sorted((r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    assert ids == [1, 4, 6, 7]


def test_intermediate_tables_go(spark):
    """A settled table stays, what was written on the way to it goes; settings of the session stay as they are."""
    import os

    from quarry.llm import common

    docs = documents(spark, ODD)
    made = []

    def make():
        made.append(common.written(docs, "way").inputFiles()[0])
        return exact.drop_copies(docs)

    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    out = common.settled(spark, make, "stays")
    assert out.count() == 5 and not os.path.exists(made[0].removeprefix("file://"))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_chosen_batch_size_stays(spark):
    from quarry.llm import common

    session = spark.newSession()
    session.conf.set(common.BATCH, "10000")
    common.small_batches(session)
    assert session.conf.get(common.BATCH) == "10000"
    other = spark.newSession()
    common.small_batches(other)
    assert other.conf.get(common.BATCH) == "1000"
