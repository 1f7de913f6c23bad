"""Secret scans, in SQL expressions only.

Three plain kinds are found by pattern, leftmost and non-overlapping: assign (a key word with a
value of 6 or more characters), access (AKIA..., 20 or more), hex (24 or more). To these, kind
markov adds runs of 20 or more characters of A-Za-z0-9+/_=- that a Markov model of random strings
explains better than one of ordinary identifiers: both are models of character pairs, trained with
smoothing from labelled samples. The sum of their log-likelihood ratios, in thousandths of a nat,
must reach ``limit``, and ``each`` for every pair of the run, so that a long run needs more than a short
one. A markov span within a span of the other kinds is left out.

Positions are in code points, ends exclusive. Spans are listed as kind:start:end by start, then by
kind in the order assign, access, hex, markov. Positions are prefix sums, made in blocks of matches,
so a text of many matches costs little more than its length.

Defined cases: a null text counts as empty and has no spans; every row gives one row, repeated
rows alike; doc_id may be null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The patterns of the plain kinds and the least length of each match or value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
VALUE_LENGTH = 6

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
#: The characters of a run, each a state of the models.
ALPHABET = UPPER + LOWER + DIGITS + "+/_=-"
#: Least sum, and least mean by pair, of the ratios.
LIMIT, EACH = 12_000, 450
#: Weight of the smoothing: pairs that a character is taken to have been seen in beside the samples'.
SMOOTH = 20.0
#: Matches in a block of a prefix sum.
BLOCK = 256

#: Parts of ordinary identifiers, for the default labelled samples.
PARTS = (
    "account action address agent array balance batch block branch buffer build button cache call change channel "
    "check child class client clock code color column command commit config connection content context control copy "
    "count create current data date default delete device document domain driver editor element empty engine entry "
    "error event export factory failure field file filter first folder format frame function graph group handler "
    "header height history image index input instance item java keyboard label language layer length level library "
    "line link list load local login manager market matrix member memory message method model module monitor mouse "
    "name network node number object offset option order output package page parent parser password path pattern "
    "people player point policy position prefix price process product profile project property protocol query queue "
    "random range reader record region register remote render report request resource response result return right "
    "router schema screen script search second section select server service session setting shape signal simple "
    "source stack start state status storage stream string style subject submit switch symbol system table target "
    "template text thread time title token total track transfer transport type unit update upload user value vector "
    "version video view widget width window worker writer"
).split()


#: Words of further languages.
FOREIGN = (
    "abteilung anwendung arbeit aufgabe ausgabe benutzer bericht daten einstellung entwicklung ergebnis fehler fenster "
    "geschwindigkeit gesellschaft konfiguration lichkeit nachricht rechnung schnittstelle sicherheit speicher "
    "sprache verbindung verwaltung wirtschaft zeitung zusammenarbeit affaires ailleurs application bibliotheque "
    "bureau chercher connaissance developpement donnees entreprise fichier gouvernement lendemain ordinateur question "
    "quelque reponse travail utilisateur administracion aplicacion archivo carpeta conocimiento desarrollo empresa "
    "especialmente gobierno informacion mensaje pregunta respuesta trabajo usuario ventana"
).split()


def _ordinary(rng: random.Random, style: int) -> str:
    """An identifier, constant, path, rule, date or word of a style of its own."""
    parts = [rng.choice(PARTS) for _ in range(rng.randint(3, 6))]
    titled = [p.title() for p in parts]
    number = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    year = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    word = "".join(rng.choice(FOREIGN + PARTS) for _ in range(rng.randint(2, 4)))
    made = (
        lambda: "_".join(parts),
        lambda: "-".join(parts),
        lambda: parts[0] + "".join(titled[1:]),
        lambda: "/".join(parts),
        lambda: "".join(parts),
        lambda: "_".join(parts).upper(),
        lambda: "".join(titled),
        lambda: "/" + "/".join((rng.choice(("usr", "var", "home", "opt", "etc")), *parts[1:], f"{parts[0]}{number(1)}-{number(1)}")),
        lambda: "/".join(f"{a}_{b.title()}" for a, b in zip(parts, parts[1:], strict=False)),
        lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        lambda: rng.choice("-=_+/") * rng.randint(20, 80),
        lambda: (rng.choice(("-=", "=-", "_-", "+-", "/=")) * 40)[: rng.randint(20, 60)],
        lambda: "+" + "+".join("-" * rng.randint(3, 20) for _ in range(3)) + "+",
        lambda: f"{year}{rng.choice('-_/')}{year.replace('-', rng.choice(('-', '')))}-{number(2)}-{number(2)}",
        lambda: f"{'-'.join(parts[:3])}-{number(1)}-{number(1)}-{number(2)}",
        lambda: f"{parts[0]}_{year.replace('-', '')}_{number(6)}_{parts[1]}",
        lambda: word,
        lambda: f"{word}-{rng.choice(FOREIGN)}",
        lambda: "-".join(titled),
        lambda: " ".join(parts).upper().replace(" ", rng.choice(("", "-"))),
    )
    return made[style % len(made)]()


def labelled_samples(n: int = 8000, seed: int = 11) -> list[tuple[str, bool]]:
    """Generated (string, is random): keys in usual alphabets, and identifiers, constants, paths, UUIDs, rules, dates and words."""
    rng, out = random.Random(seed), []
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", UPPER + "234567", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_", LOWER + DIGITS, UPPER + DIGITS]
    for k in range(n):
        alphabet = alphabets[k % len(alphabets)]
        out.append(("".join(rng.choice(alphabet) for _ in range(rng.randint(20, 48))), True))
        name = _ordinary(rng, k)
        out.append((name + (str(rng.randint(0, 99)) if rng.random() < 0.1 else ""), False))
    return out


def train(samples: list[tuple[str, bool]]) -> list[int]:
    """Log-likelihood ratios, random over ordinary, of each pair of characters, in thousandths of a nat."""
    pairs = {True: Counter(), False: Counter()}
    for text, is_random in samples:
        pairs[is_random].update(zip(text, text[1:], strict=False))
    out = []
    for a in ALPHABET:
        total = {kind: sum(pairs[kind][a, b] for b in ALPHABET) + SMOOTH for kind in pairs}
        for b in ALPHABET:
            p = {kind: (pairs[kind][a, b] + SMOOTH / len(ALPHABET)) / total[kind] for kind in pairs}
            out.append(round(1000 * math.log(p[True] / p[False])))
    return out


@lru_cache
def default_model() -> tuple[int, ...]:
    return tuple(train(labelled_samples()))


def _bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _upto(values: Column, zero: int, join) -> Column:
    """At each place the values so far joined by an associative function, in blocks of BLOCK values: no list grows by one element at a time."""

    def grown(start: Column, items: Column) -> Column:
        walked = F.aggregate(items, F.array(start), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x))))
        return F.slice(walked, 2, F.size(items))

    def of_values(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")))
        return _bind(F.transform(places, lambda k: F.slice(v, k * BLOCK + 1, BLOCK)), of_blocks)

    def of_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero).cast("long"), join))
        return _bind(grown(F.lit(zero).cast("long"), sums), lambda ends: F.flatten(F.transform(blocks, lambda b, k: grown(F.when(k == 0, F.lit(zero).cast("long")).otherwise(F.get(ends, k - 1)), b))))

    return _bind(values, of_values)


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None, with_run: bool = False) -> Column:
    """array<(start, kind, end, v, run)> of the matches, from the lengths of matches and of what is between them."""
    kind_of_span = "array<struct<start:bigint,kind:int,end:bigint,v:int,run:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group or 0))

    def steps(between: Column) -> Column:
        sized = F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), F.length(gap).cast("long").alias("gap")))
        return F.zip_with(F.filter(sized, lambda s: s["m"].isNotNull()), value, lambda s, v: F.struct(s["gap"].alias("gap"), F.length(s["m"]).cast("long").alias("n"), F.length(v).alias("v"), s["m"].alias("m")))

    def placed(steps: Column) -> Column:
        ends = _upto(F.transform(steps, lambda s: s["gap"] + s["n"]), 0, lambda a, b: a + b)
        return F.zip_with(steps, ends, lambda s, e: F.struct((e - s["n"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), s["v"].alias("v"), (s["m"] if with_run else F.lit(None).cast("string")).alias("run"))).cast(kind_of_span)

    walked = _bind(steps(F.split(text, pattern, -1)), placed)
    if value_group:
        walked = F.filter(walked, lambda s: s["v"] >= VALUE_LENGTH)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(kind_of_span))


def _outside(runs: Column, base: Column) -> Column:
    """The runs that lie in no span of base: no span that starts before a run, or with it, ends with it or later."""

    def of_all(spans: Column) -> Column:
        reach = _upto(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(F.lit(0).cast("long"))), 0, lambda a, b: F.greatest(a, b))
        return F.filter(F.zip_with(spans, reach, lambda s, e: F.when((s["kind"] == 3) & (e < s["end"]), s)), lambda s: s.isNotNull())

    return F.when((F.size(runs) == 0) | (F.size(base) == 0), runs).otherwise(_bind(F.array_sort(F.concat(base, runs)), of_all))


def _ratio(token: Column, model: Column) -> Column:
    """Sum of the model's entries over the token's pairs of characters."""
    where = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    return F.aggregate(
        F.filter(F.split(token, ""), lambda c: c != ""),
        F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda acc, c: F.struct(
            F.get(where, F.ascii(c)).alias("last"),
            (acc["sum"] + F.when(acc["last"] >= 0, F.get(model, acc["last"] * len(ALPHABET) + F.get(where, F.ascii(c)))).otherwise(0)).cast("long").alias("sum"),
        ),
        lambda acc: acc["sum"],
    )


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "markov")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: tuple[int, ...] | None = None, limit: int = LIMIT, each: int = EACH) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of each row."""
    table = F.split(F.lit(",".join(map(str, model or default_model()))), ",").cast("array<int>")
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select(
        "doc_id",
        _spans(F.col("text"), ASSIGN, 0, 2).alias("assign"),
        _spans(F.col("text"), ACCESS, 1).alias("access"),
        _spans(F.col("text"), HEX, 2).alias("hex"),
        _spans(F.col("text"), RUN, 3, with_run=True).alias("runs"),
    )
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("outside", _outside(F.col("runs"), F.col("base")))

    def odd(r: Column) -> Column:
        return _bind(_ratio(r["run"], table), lambda x: (x >= limit) & (x >= each * (r["end"] - r["start"] - 1)))

    rows = rows.withColumn("markov", F.when(F.size("outside") > 0, F.filter("outside", odd)).otherwise(F.col("outside")))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )


def oracle() -> str:
    """DuckDB SQL of ``scan`` over documents with the default model."""

    def spans(kind: str, pattern: str, least: str = "") -> str:
        p = pattern.replace("'", "''")
        return f"""
        {kind}_m AS (SELECT row_no, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {2 if least else 0}) AS v,
                regexp_split_to_array(text, '{p}') AS gap FROM docs WHERE regexp_matches(text, '{p}')),
        {kind}_s AS (SELECT row_no, unnest([{{'start': list_sum(list_transform(gap[1:i], lambda g: length(g)))::BIGINT
                    + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0)::BIGINT, 'n': length(m[i]), 'v': length(v[i])}}
                    for i in range(1, len(m) + 1)]) AS s FROM {kind}_m),
        {kind} AS (SELECT row_no, s.start AS s, s.start + s.n AS e FROM {kind}_s {least})"""

    model = "[" + ",".join(map(str, default_model())) + "]"
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
    {spans("assign", ASSIGN, f"WHERE s.v >= {VALUE_LENGTH}")},
    {spans("access", ACCESS)},
    {spans("hex", HEX)},
    {spans("run", RUN)},
    base AS (SELECT row_no, s, e, 0 AS k FROM assign UNION ALL SELECT row_no, s, e, 1 FROM access UNION ALL SELECT row_no, s, e, 2 FROM hex),
    free AS (SELECT r.row_no, r.s, r.e, substring(d.text, r.s + 1, r.e - r.s) AS t
        FROM run r JOIN docs d USING (row_no)
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = r.row_no AND b.s <= r.s AND r.e <= b.e)),
    scored AS (SELECT row_no, s, e, length(t) - 1 AS pairs, list_sum([({model})[(instr('{ALPHABET}', t[i]) - 1) * {len(ALPHABET)} + instr('{ALPHABET}', t[i + 1])]
        for i in range(1, length(t))]) AS ratio FROM free),
    every AS (SELECT * FROM base UNION ALL SELECT row_no, s, e, 3 FROM scored WHERE ratio >= {LIMIT} AND ratio >= {EACH} * pairs),
    named AS (SELECT row_no, k, s, e, ['assign', 'access', 'hex', 'markov'][k + 1] || ':' || s || ':' || e AS span FROM every),
    listed AS (SELECT row_no, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        count(*) FILTER (k = 3) AS n_markov, string_agg(span, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY s, k) AS spans
        FROM named GROUP BY row_no)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        coalesce(n_markov, 0) AS n_markov, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN listed USING (row_no)"""
