"""Line dedup by winnowing over line hashes, in SQL expressions only.

Lines are compared with white space collapsed; blank lines are passed over. A window starts at each
line and ends with the line that completes ``words`` words (one line, of most lines), so every run of lines of that
many words that two places share holds a whole window in both. A window selects the least of its line hashes
as its fingerprint: equal windows select the same line. Positions of fingerprints are joined by line hash, and those whose line has
no other position are dropped, with the windows that selected them. The windows of the others are matched by content:
every one but the first of its content (by doc_id, then position) is a repeat. A match reaches both ways: to the left by
the windows that start at the lines before, to the right also by the lines after its window that are equal to those after the first
occurrence (fewer than ``words`` lines: more would be a window of their own, so each window carries that many hashes
and no text meets another). The lines of all repeats are deleted. An equal line always stays at an earlier place, also where a
text repeats itself.

Defined cases: a null text counts as empty; a null doc_id comes last; equal rows are one document and fare alike, rows of one
doc_id with different texts are ordered by the MD5 of the text; a repeated run of fewer than ``words`` words stays; an empty table gives an empty
result; other columns are ignored by ``repeats`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, text_of, written

#: Words of a run of lines that is deleted where it recurs.
WORDS = 5


def _lines(text: Column) -> Column:
    """array<(no, h, w)> of the lines that are not blank: number from 0, hash, words."""
    plain = F.split(F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " "), "\n")
    trimmed = F.transform(plain, lambda x: F.trim(x))
    found = F.transform(trimmed, lambda x, i: F.struct(i.alias("no"), F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w")))
    return F.filter(found, lambda x: x["w"] > 0)


def _length(w: Column, i: Column, words: int) -> Column:
    """Lines of the window that starts at the i-th line (from 1); 0 if the text ends before."""
    step = F.aggregate(
        F.slice(w, i, words),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
        lambda a, x: F.when(a["sum"] >= words, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["n"] + 1).alias("n"))),
        lambda a: F.when(a["sum"] >= words, a["n"]).otherwise(0),
    )
    return F.when(F.get(w, i - 1) >= words, 1).otherwise(step)


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def hashed(docs: DataFrame) -> DataFrame:
    """id, th (a document), n_lines, no, h, w: the lines' numbers, hashes and words as arrays."""
    rows = docs.select(
        F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.unhex(F.md5(text_of())).alias("th"),
        (F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"), F.lit(""))) + 1).alias("n_lines"), _lines(text_of()).alias("lines"),
    )
    return rows.select("id", "th", "n_lines", *[F.col(f"lines.{k}").alias(k) for k in ("no", "h", "w")])


def positions(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """id, th, at, f, windows: the fingerprints of each text, place and line hash, and the windows that select each:
    array<(i, len, at, key, tail)>, tail the hashes of the lines after the window."""

    def window(i: Column) -> Column:
        return _bind(_length(F.col("w"), i, words), lambda n: _bind(F.slice("h", i, F.greatest(n, F.lit(1))), lambda own: F.struct(
            i.alias("i"), n.alias("len"), (i + F.array_position(own, F.array_min(own)).cast("int") - 1).alias("at"),
            F.xxhash64(own).alias("key"), F.slice("h", i + n, words - 1).alias("tail"),
        )))

    # a text's last lines may start no window; all others do
    windows = F.filter(F.transform(F.sequence(F.lit(1), F.size("h")), window), lambda x: x["len"] > 0)
    found = texts.filter(F.size("h") > 0).select("id", "th", "h", windows.alias("x"))
    # the windows of a position start at it or less than ``words`` lines before
    of_place = F.transform(F.array_distinct("x.at"), lambda at: F.struct(
        at.alias("at"), F.get("h", at - 1).alias("f"), F.filter(F.slice("x", F.greatest(at - (words - 1), F.lit(1)), words), lambda x: x["at"] == at).alias("windows"),
    ))
    return found.select("id", "th", F.explode(of_place).alias("p")).select("id", "th", "p.*")


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of docs: id, th, n_lines, runs array<(first, last)> of deleted line numbers, from 0, and gone, their lines that are not blank."""
    every = written(hashed(docs), "lines")
    placed = written(positions(every.dropDuplicates(["id", "th"]), words), "positions")
    place = F.struct("id", "th", "at")
    shared = placed.groupBy("f").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("f")
    # Written tables on both sides of a join let its hot keys be split.
    again = placed.join(written(shared, "shared"), "f").select("f", "id", "th", F.explode("windows").alias("x")).select("f", "id", "th", "x.i", "x.len", "x.key", "x.tail")
    again = written(again, "windows")
    first = again.groupBy("f", "key", "len").agg(F.min(F.struct("id", "th", "i", "tail")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    hits = again.join(written(first, "first"), ["f", "key", "len"]).filter(F.struct("id", "th", "i") != F.struct("first.id", "first.th", "first.i"))
    spans = hits.select("id", "th", F.col("i").alias("a"), (F.col("i") + F.col("len") - 1 + _common(F.col("tail"), F.col("first.tail"))).alias("b"))
    # A text's spans, joined where they touch.
    before = Window.partitionBy("id", "th").orderBy("a", "b")
    reach = F.max("b").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int"))
    runs = spans.withColumn("run", F.sum("new").over(before)).groupBy("id", "th", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    # No more than the text's lines.
    runs = written(runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans")), "runs")
    return every.join(runs, ["id", "th"], "left").select(
        "id", "th", "n_lines",
        F.coalesce(F.transform("spans", lambda r: F.struct(F.get("no", r["a"] - 1).alias("first"), F.get("no", r["b"] - 1).alias("last"))), F.array().cast("array<struct<first:int,last:int>>")).alias("runs"),
        F.coalesce(F.flatten(F.transform("spans", lambda r: F.slice("no", r["a"], r["b"] - r["a"] + 1))), F.array().cast("array<int>")).alias("gone"),
    )


def line_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed (lines that are not blank), removed (runs first-last, by line number from 0)."""
    return repeats(docs, words).select(
        F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["first"].cast("string"), r["last"].cast("string"))), ",").alias("removed"),
    )


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the repeated lines deleted from their texts; n_chars is not recomputed."""
    gone = repeats(docs, words).filter(F.size("gone") > 0).distinct()
    gone = written(gone.select(F.col("id").alias("__quarry_id"), F.col("th").alias("__quarry_th"), F.col("gone").alias("__quarry_gone")), "gone")
    key = (F.coalesce(docs["doc_id"], F.lit(LAST_ID)) == gone["__quarry_id"]) & (F.unhex(F.md5(text_of())) == gone["__quarry_th"])
    drop = gone["__quarry_gone"]
    # the lines of a text that stay: those whose numbers are not among the deleted
    lines = F.split(text_of(), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop)
    kept = F.when(drop.isNull(), docs["text"]).otherwise(_bind(lines, lambda x: F.array_join(F.transform(left, lambda k: F.get(x, k)), "\n")))
    return docs.join(gone, key, "left").select(*[kept.alias(c) if c == "text" else docs[c] for c in docs.columns])


def oracle(words: int = WORDS) -> str:
    """DuckDB SQL of ``line_report`` over documents whose rows differ, by all windows and without fingerprints."""
    on = "[coalesce(a.x[w.j + k] = b.x[w.fi + w.j - w.i + k], false) for k in range(1, least(len(a.x) - w.j, %d) + 1)]" % (words - 1)
    return rf"""
    WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS n, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT n, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM docs),
    lines AS (SELECT n, no, trim(regexp_replace(raw, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ') AS x FROM split),
    full_lines AS (SELECT n, no, x, row_number() OVER (PARTITION BY n ORDER BY no) AS i, len(string_split(x, ' ')) AS w FROM lines WHERE x <> ''),
    a AS (SELECT n, list(x ORDER BY i) AS x, list(no ORDER BY i) AS no, list(w ORDER BY i) AS w FROM full_lines GROUP BY n),
    ends AS (SELECT f.n, f.i, f.i - 1 + list_position([list_sum(a.w[f.i:f.i + k]) >= {words} for k in range(0, {words})], true) AS j,
        len(a.x) AS m FROM full_lines f JOIN a USING (n)),
    wins AS (SELECT e.n, e.i, e.j, array_to_string(a.x[e.i:e.j], chr(10)) AS content FROM ends e JOIN a USING (n) WHERE e.j >= e.i AND e.j <= m),
    firsts AS (SELECT content, min(row(n, i)) AS f FROM wins GROUP BY content),
    hits AS (SELECT w.n, w.i, w.j, f[1] AS fn, f[2] AS fi FROM wins w JOIN firsts USING (content) WHERE row(w.n, w.i) <> f),
    spans AS (SELECT w.n, w.i AS low, w.j + coalesce(nullif(list_position({on}, false), 0) - 1, len({on})) AS high
        FROM hits w JOIN a ON a.n = w.n JOIN a b ON b.n = w.fn),
    marked AS (SELECT *, coalesce(low > max(high) OVER (PARTITION BY n ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true) AS new FROM spans),
    numbered AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY n ORDER BY low, high) AS run FROM marked),
    runs AS (SELECT n, run, min(low) AS low, max(high) AS high FROM numbered GROUP BY n, run),
    removed AS (SELECT r.n, sum(high - low + 1) AS n_removed, string_agg(a.no[r.low] || '-' || a.no[r.high], ',' ORDER BY r.low) AS removed FROM runs r JOIN a USING (n) GROUP BY r.n)
    SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
    FROM docs LEFT JOIN removed USING (n)"""
