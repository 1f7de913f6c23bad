import random
import re

from quarry.llm import lines

from ..oracle import compare, connection
from .helpers import ODD, documents

SF = "/root/testdata/sf0.001"


def brute(docs, least=lines.WORDS):
    """Deleted line numbers per document, in order of doc_id: every window that is not the first of its content, with
    the equal lines after it."""
    every = []
    for i, t in docs:
        ls = [(k, re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).strip(" ")) for k, x in enumerate((t or "").split("\n"))]
        every.append((i, [(k, x) for k, x in ls if x]))
    every.sort()
    first, windows = {}, {}
    for n, (_, ls) in enumerate(every):
        for p in range(len(ls)):
            count = 0
            for q in range(p, len(ls)):
                count += len(ls[q][1].split(" "))
                if count >= least:
                    key = tuple(x for _, x in ls[p : q + 1])
                    first.setdefault(key, (n, p))
                    windows[n, p] = (key, q)
                    break
    out = {i: set() for i, _ in every}
    for (n, p), (key, q) in windows.items():
        m, r = first[key]
        if (m, r) != (n, p):
            (i, ls), other = every[n], every[m][1]
            out[i] |= set(range(p, q + 1))
            e = r + q - p
            for k in range(1, least):
                if q + k >= len(ls) or e + k >= len(other) or ls[q + k][1] != other[e + k][1]:
                    break
                out[i].add(q + k)
            # what is equal on the left is a repeat already
            if p and r and ls[p - 1][1] == other[r - 1][1]:
                assert first[windows[n, p - 1][0]] != (n, p - 1)
    return {i: [ls[g][0] for g in sorted(out[i])] for i, ls in every}


def got(docs):
    return {r.id: list(r.gone) for r in lines.repeats(docs).collect()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    pool = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice((1, 1, 2, 3, 10, 30)))) for _ in range(40)]
    rows = [(i, "\n".join(rng.choice([*pool, "", "  "]) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    rows.append((90, "\n".join([pool[0]] * 200)))
    rows.append((91, "\n".join([pool[1], pool[2]] * 60)))
    docs = documents(spark, rows)
    assert got(docs) == brute(rows)
    texts = {r.doc_id: r.text for r in lines.without_repeats(docs).collect()}
    for i, t in rows:
        gone = set(brute(rows)[i])
        assert texts[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)


def test_passage_across_documents(spark):
    passage = "\n".join(" ".join(f"p{i}{k}" for k in range(12)) for i in range(5))
    rows = [(1, "own one\n" + passage + "\nmore"), (2, "own two\n" + passage + "\nrest"), (3, "own three alone")]
    report = {r.doc_id: (r.n_removed, r.removed) for r in lines.line_report(documents(spark, rows)).collect()}
    assert report == {1: (0, ""), 2: (5, "1-5"), 3: (0, "")}


def test_long_text_of_many_stretches(spark):
    """20,000 repeats in one text of 60,000 lines: no array of lines is copied by stretch."""
    rng = random.Random(6)
    common = [f"common line number {k} is here" for k in range(50)]
    long = "\n".join(rng.choice(common) if k % 3 == 0 else f"own line number {k} stands alone" for k in range(60_000))
    rows = [(1, "\n".join(common)), (2, long)]
    got = {r.doc_id: r.n_removed for r in lines.line_report(documents(spark, rows)).collect()}
    assert got == {1: 0, 2: 20_000}


def test_half_of_the_positions_or_fewer(spark):
    """Winnowing: of short lines, a window selects its least hash, so there are fewer fingerprints than windows."""
    rng = random.Random(8)
    docs = documents(spark, [(i, "\n".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(10)])
    found = lines.positions(lines.hashed(docs)).selectExpr("count(*) AS n", "sum(size(windows)) AS windows").first()
    assert found.windows == 10 * 196 and found.n < 0.45 * found.windows


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumnRenamed("lang", "th")
    out = lines.line_report(docs).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in out), key=repr) == sorted(((i, 0) for i, _ in ODD), key=repr)
    twice = documents(spark, [(3, "a line of five words\nmore"), (None, "a line of five words\nrest"), (None, None), (3, "a line of five words\nmore"), (9, "a line of five words")])
    assert sorted(((r.doc_id, r.n_removed) for r in lines.line_report(twice).collect()), key=repr) == [(3, 0), (3, 0), (9, 1), (None, 0), (None, 1)]
    kept = lines.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert lines.line_report(documents(spark, [])).count() == 0


def test_equals_sql(spark):
    compare(spark, connection(SF), "op3", lambda s, d: lines.line_report(s.read.parquet(f"{d}/documents.parquet")), lines.oracle(), SF)
