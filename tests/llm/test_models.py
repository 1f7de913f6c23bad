"""Toxicity and HTML: held-out accuracy, labels that may not be read, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import html, toxicity

from .helpers import ODD, documents, held_out, words

BAD = ["vile", "rotten", "foulest", "wretched"]


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.15
        w = words(rng, rng.randrange(30, 120))
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", "ness", "er"]))
        rows.append((i, " ".join(w)))
        if rng.random() < 0.6:
            marks.append((i, 1, int(toxic)))
    return documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), {d: t for d, _, t in marks}


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i].held_out == held_out(i) for i in got)
    test = [i for i in truth if held_out(i)]
    assert sum(got[i].predicted == truth[i] for i in test) / len(test) > 0.95
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_held_out_labels_and_other_columns_do_not_count(spark):
    docs, labels, _ = corpus(spark)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.toxicity_scores(other, turned).collect()}


def test_odd_rows(spark):
    docs, labels, _ = corpus(spark, 300)
    odd = docs.unionByName(documents(spark, ODD)).withColumn("score", F.lit("clash"))
    out = toxicity.toxicity_scores(odd, labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema)))
    assert out.count() == 300 + len(ODD) and out.filter("score is null or score < 0 or score > 1").count() == 0
    none = toxicity.toxicity_scores(docs, labels.filter("toxic = 0"))
    assert none.filter("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(documents(spark, []), labels.limit(0)).count() == 0


def test_non_negative_risk_needs_no_negatives():
    """Weights grow for the buckets of confirmed texts alone, whatever else the unlabelled hold."""
    import numpy as np

    rng = np.random.default_rng(0)
    texts = [np.array([1]) for _ in range(50)] + [np.array([1]) if rng.random() < 0.1 else np.array([2]) for _ in range(500)]
    w, b = toxicity.fit(texts, np.arange(550) < 50, 0.1, toxicity.Sample(buckets=8))
    assert w[1] + b > 0 > w[2] + b


def risk(z, positive, prior):
    """The non-negative risk by its definition, a text at a time."""
    import math

    def loss(z):
        return 1 / (1 + math.exp(z))

    p = [x for x, y in zip(z, positive, strict=True) if y]
    u = [x for x, y in zip(z, positive, strict=True) if not y]
    wrong = sum(loss(-x) for x in u) / len(u) - prior * sum(loss(-x) for x in p) / len(p)
    return prior * sum(loss(x) for x in p) / len(p) + max(0.0, wrong)


def test_fit_against_all_weights_of_a_grid():
    """The risk of the fitted weights is no more than that of any weights of a grid."""
    import itertools

    import numpy as np

    rng = random.Random(4)
    texts = [[0] if rng.random() < 0.8 else [0, 1] for _ in range(40)] + [[0, 1] if rng.random() < 0.2 else [1] if rng.random() < 0.6 else [] for _ in range(160)]
    positive = np.arange(200) < 40
    w, b = toxicity.fit([np.array(t, np.int64) for t in texts], positive, 0.2, toxicity.Sample(buckets=2, epochs=3000, rate=0.05))
    mine = risk([sum(w[k] for k in t) + b for t in texts], positive, 0.2)
    grid = [x / 2 for x in range(-16, 17)]
    best = min(risk([sum((x, y)[k] for k in t) + c for t in texts], positive, 0.2) for x, y, c in itertools.product(grid, grid[::2], grid))
    assert mine <= best + 0.002


def plain_scores(rows, marks, s):
    """The operator without Spark: the sample, the choice of buckets and the scores of every text."""
    import numpy as np
    import xxhash

    def key(i):
        h = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
        return (h - 2**64 if h >= 2**63 else h), i

    texts = {i: t or "" for i, t in rows}
    learn = [(i, t) for i, _, t in marks if not held_out(i)]
    prior = sum(t for _, t in learn) / len(learn)
    confirmed = sorted({i for i, t in learn if t}, key=key)[: s.positives]
    others = sorted((i for i in texts if not held_out(i)), key=key)[: s.unlabelled]
    chosen_of = [(sorted(f for w in toxicity.text_words(texts[i]) for f in toxicity.features(w, s.buckets)), y) for y, ids in ((False, others), (True, confirmed)) for i in ids if i in texts]
    n = {y: sum(1 for _, z in chosen_of if z == y) for y in (True, False)}
    z = {}
    for k in {k for b, _ in chosen_of for k in b}:
        p, u = (sum(1 for b, y in chosen_of if y == kind and k in b) for kind in (True, False))
        expected = n[True] * max(u, 1) / n[False]
        if p >= 3 and (p - expected) / expected**0.5 > s.min_z:
            z[k] = (p - expected) / expected**0.5
    best = set(sorted(z, key=lambda k: (-z[k], k))[: s.chosen])
    w, b = toxicity.fit([np.array([k for k in bs if k in best], np.int64) for bs, _ in chosen_of], np.array([y for _, y in chosen_of]), prior, s)
    out = {}
    for i, t in texts.items():
        total = b + sum(w[k] for word in toxicity.text_words(t) for k in toxicity.features(word, s.buckets))
        out[i] = 1 / (1 + np.exp(-total))
    return out


def test_scores_equal_a_plain_version(spark):
    docs, labels, _ = corpus(spark, 500, 7)
    s = toxicity.Sample(positives=30, unlabelled=150, min_z=3.0, chosen=40)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_scores(rows, [tuple(r) for r in labels.collect()], s)
    got = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels, s).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_sample_bounds_hold_for_repeated_rows(spark):
    docs, labels, _ = corpus(spark, 300)
    toxic = labels.filter("toxic = 1").filter(~toxicity.held_out()).first().doc_id
    again = docs.filter(F.col("doc_id") == toxic).crossJoin(spark.range(20_000)).drop("id")
    s = toxicity.Sample(positives=5, unlabelled=10, min_z=0.0)
    rows, _ = toxicity.training_sample(docs.unionByName(again), labels.unionByName(labels), s)
    assert rows.positive.sum() == 5 and len(rows) == 15
    assert max(map(len, toxicity.training_sample(docs, labels, toxicity.Sample(positives=50, unlabelled=10, min_z=0.0, chosen=3))[0].buckets)) <= 3
    many = spark.range(100_000).withColumnRenamed("id", "doc_id")
    key = F.xxhash64("doc_id")
    assert toxicity.least_ids(many, 50).collect() == many.orderBy(key).limit(50).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice">We use cookies</div><header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div class="ad">Buy this now</div><article><h1>A title &amp; more</h1><p>First  paragraph of the text,
which is long enough to be read as an article by anyone who reads it.<p>Second one &lt;here&gt; with <b>bold</b> and a <a href="/x">link</a>.<br>And a line.</p>
<ul><li>one item of the list</li><li>another item</li></ul></article><section id="comments"><p>I think this is a great article, thank you all</p></section>
<aside class="sidebar"><p>Popular things</p></aside><form><input><p>Subscribe</p></form><footer>&copy; 2024 someone</footer></body></html>"""
TEXT = [
    "A title & more", "First paragraph of the text, which is long enough to be read as an article by anyone who reads it.",
    "Second one <here> with bold and a link. And a line.", "one item of the list", "another item",
]


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "", ""), (None, "x", "<p>cut <b>off"), (1, "u", PAGE)], "page_id long, url string, html string")
    got = html.page_texts(pages.withColumn("text", F.lit(1))).collect()
    assert len(got) == 5
    by = {r.url: r for r in got}
    assert by["u"].text == "\n\n".join(TEXT) and by["u"].n_chars == len(by["u"].text)
    assert by[""].text == by[None].text == "" and by[""].n_chars == 0
    assert html.page_texts(pages.limit(0)).count() == 0


def test_generated_pages_held_out():
    rng, trees, good = random.Random(77), html.model(), 0
    for _ in range(100):
        page, truth = html.sample_page(rng)
        nodes = html.parse(page)
        chosen = html.decode(nodes, trees.log_odds(html.np.array(html.node_features(nodes), float)))
        good += [id(n) in chosen for n in nodes if n.tag == "#text"] == truth
    assert good >= 95


def test_decoding_is_consistent():
    nodes = html.parse("<div><p>a</p><div><p>b</p></div></div>")
    rng = random.Random(1)
    for _ in range(50):
        odds = html.np.array([rng.uniform(-3, 3) for _ in nodes])
        chosen = html.decode(nodes, odds)
        assert all(n.parent is None or id(n.parent) in chosen for n in nodes if id(n) in chosen)


def test_parser_gives_all_text():
    page = "a<p>b<p>c<div>d<span>e</span>f</div><ul><li>g<li>h</ul><table><tr><td>i<td>j</table><!-- no -->k<script>no</script>&#65;"
    assert [" ".join("".join(n.text).split()) for n in html.parse(page) if n.tag == "#text"] == ["a", "b", "c", "def", "g", "h", "i", "j", "kA"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("a<datalist id=x><option value=a>1<option value=b>2</datalist><p>b<p>c", ["a", "b", "c"]),
        ("<header>a<button>menu</header><p>b</p><button>more</button><p>c", ["a", "b", "c"]),
        ("<header>a<svg><path d='x'><g></header><main><p>b</main>c", ["a", "b", "c"]),
        ("a<svg><title>t</title><path><p>b</p>", ["a", "b"]),
        ("<div>a<select><option>1<option>2</div><p>b", ["a", "b"]),
        ("<div><iframe src=x></div><p>a<noscript><div><img></div>no</noscript>b", ["ab"]),
        ("<ul><li>a<button>x<li>b<button><div>y</div></button>c</ul><button>z<main>d</main>", ["a", "bc", "d"]),
        ("a <select><optgroup><option>1</option></optgroup><option>2</select> b", ["a b"]),
        ("<div>a<button><div>x</div><ul><li>y</ul></button>b</div>c<svg/>d", ["ab", "cd"]),
        ("<div><template><div>x</div></template>a<script>var s = '<p>';</script></div>", ["a"]),
    ],
)
def test_excluded_subtrees_take_nothing_else(page, want):
    assert [" ".join("".join(n.text).split()) for n in html.parse(page) if n.tag == "#text"] == want


def test_decoding_equals_all_labelings():
    """Of all labelings of small trees in which no main node lies under one that is not, the likeliest."""
    import itertools

    rng = random.Random(3)
    for _ in range(60):
        nodes = [html.Node("#root", None)]
        for _ in range(rng.randrange(1, 9)):
            up = rng.choice(nodes)
            nodes.append(html.Node("div", up))
            up.children.append(nodes[-1])
        order, todo = [], [nodes[0]]
        while todo:  # page order
            order.append(todo.pop())
            todo += reversed(order[-1].children)
        odds = html.np.array([rng.uniform(-3, 3) for _ in order])
        yes, no = -html.np.logaddexp(0, -odds), -html.np.logaddexp(0, odds)
        place = {id(n): k for k, n in enumerate(order)}
        allowed = [m for m in itertools.product((False, True), repeat=len(order)) if all(not m[k] or n.parent is None or m[place[id(n.parent)]] for k, n in enumerate(order))]
        best = max(allowed, key=lambda m: sum(yes[k] if x else no[k] for k, x in enumerate(m)))
        chosen = html.decode(order, odds)
        assert [id(n) in chosen for n in order] == list(best)


def test_hand_written_pages():
    """Word precision and recall over pages of shapes that were not trained on."""
    from collections import Counter

    from .hand_pages import PAGES

    common = found = wanted = 0
    for page, want in PAGES:
        got = html.extract([page], html.model())[0].split("\n\n")
        a, b = Counter(w for x in got for w in x.split()), Counter(w for x in want for w in x.split())
        common, found, wanted = common + sum((a & b).values()), found + sum(a.values()), wanted + sum(b.values())
        assert [x for x in want if x in got] == want  # no block of the text is lost
    assert common / found >= 0.98 and common == wanted


def test_unclosed_elements_lose_no_article_text():
    """The whole of a page's text, also after what is left open."""
    body = "<p>First paragraph of a text that is long enough to be the article of this page.</p>{}<p>Second paragraph of the same text, which must be kept as well as the first.</p>"
    want = ["First paragraph of a text that is long enough to be the article of this page.", "Second paragraph of the same text, which must be kept as well as the first."]
    for odd in ("<datalist><option value=a><option value=b></datalist>", "<button>", "<select><option>a", "<svg><path>", "<iframe src=x>"):
        page = f"<html><body><article>{body.format(f'<div>{odd}</div>')}</article><footer>&copy; somebody</footer></body></html>"
        assert html.extract([page], html.model())[0].split("\n\n") == want, odd
