"""Null and coercion rules of predicates, clause order, groups; random trees against a plain model."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.functions.predicates import Op, parse_number
from quarry.plans.query import query

ROWS = [(1, 1, "ABC"), (2, 2, "a.c"), (3, None, None), (4, 3, "12"), (5, 3, "1e5"), (6, -1, " 7 "), (7, 0, "1.5"), (8, 2, "x\ny")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id int, v int, s string").cache()


def ids(q, rows, **how):
    return sorted(r.id for r in q.execute(rows, **how).collect())


def test_not_is_two_valued(rows):
    assert ids(query().group_start("NOT").where_eq("v", 1).group_end(), rows) == [2, 3, 4, 5, 6, 7, 8]
    assert ids(query().group_start("AND", negated=True).where_eq("v", 1).group_end(), rows) == [2, 3, 4, 5, 6, 7, 8]


def test_not_in_with_null_in_the_list(rows):
    assert ids(query().where_not_in("v", [1, None]), rows) == [2, 4, 5, 6, 7, 8]
    assert ids(query().where_in("v", []), rows) == []
    assert ids(query().where_not_in("v", []), rows) == [1, 2, 4, 5, 6, 7, 8]


def test_text_against_numbers(rows):
    assert ids(query().where_eq("s", 12), rows) == [4]
    assert ids(query().where_ne("s", 12), rows) == [1, 2, 5, 6, 7, 8]  # texts that are no numbers differ
    assert ids(query().where_gt("s", 1), rows) == [4, 6, 7]  # "1e5" has no point and is no number
    assert parse_number("1e5") is None and parse_number("1.5e1") == 15.0


def test_number_against_texts(rows):
    assert ids(query().where_eq("v", "3"), rows) == [4, 5]
    assert ids(query().where_eq("v", "x"), rows) == []
    assert ids(query().where_ne("v", "x"), rows) == [1, 2, 4, 5, 6, 7, 8]
    with pytest.raises(TypeError):
        query().where_in("v", ["3"]).execute(rows)


def test_like(rows):
    assert ids(query().where_like("s", "a_c"), rows) == [1, 2]
    assert ids(query().where_like("s", "a.c"), rows) == [2]
    assert ids(query().where_like("s", "x%y"), rows) == [8]
    assert ids(query().where_like("s", "x%y"), rows, strict_like=True) == []


def test_or_takes_all_before_it(rows):
    assert ids(query().where_eq("v", 1).where_eq("s", "zzz").or_where("v", "=", 3), rows) == [1, 4, 5]


def test_nested_groups(rows):
    q = query().where_gt("id", 1).group_start("OR").where_eq("v", 2).group_start("AND").where_eq("v", 3).where_eq("s", "12").group_end().group_end()
    assert ids(q, rows) == [2, 4, 8]
    with pytest.raises(ValueError):
        query().group_end()
    with pytest.raises(ValueError):
        query().where("v", "~~", 1)


def test_null_order(rows):
    order = lambda q: [r.id for r in q.execute(rows.filter("id in (1, 3, 4)")).collect()]
    assert order(query().order_by("v")) == [1, 4, 3]
    assert order(query().order_by("v", "desc")) == [3, 4, 1]
    assert order(query().order_by("v", "desc", nulls_first=False)) == [4, 1, 3]
    assert order(query().order_by("v", nulls_first=True)) == [3, 1, 4]


def test_limit_before_distinct(rows):
    q = query().select("v").order_by("id", "desc").limit(3).distinct()
    assert sorted(r.v for r in q.execute(rows).collect()) == [-1, 0, 2]


def test_unknown_columns(rows):
    assert query().select("id", "nope").limit(1).execute(rows).first().nope is None
    assert ids(query().where_null("nope"), rows) == list(range(1, 9))
    assert ids(query().where_ne("nope", 1), rows) == []


def test_aggregates(rows):
    q = query().count().count("v").sum("v", "s").avg("v", "a").order_by("s")
    r = q.execute(rows).first()
    assert (r["COUNT_*"], r["COUNT_v"], r["s"], round(r["a"], 6)) == (8, 7, 10, round(10 / 7, 6))
    assert query().group_by("v").execute(rows).count() == 6
    assert query().group_by("v").execute(rows, strict_compat=True).count() == 8
    empty = query().where_gt("id", 99).sum("v", "s").count(alias="n").execute(rows).first()
    assert empty.s is None and empty.n == 0


def test_filters_reach_the_scan(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = query().select("l_orderkey").where_gt("l_quantity", 10).where_eq("l_returnflag", "A").execute(lines)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(l_quantity,10" in plan and "EqualTo(l_returnflag,A)" in plan
    assert "l_extendedprice" not in plan


CONDITION = st.tuples(st.sampled_from(["id", "v"]), st.sampled_from([Op.EQ, Op.NE, Op.LT, Op.LE, Op.GT, Op.GE, Op.IS_NULL, Op.IN, Op.NOT_IN]), st.integers(-1, 4))
TREE = st.recursive(CONDITION, lambda t: st.tuples(st.sampled_from(["AND", "OR", "NOT"]), st.booleans(), st.lists(t, max_size=3)), max_leaves=6)


def model(tree, row):
    if isinstance(tree[2], list):
        kind, negated, parts = tree
        if not parts:
            return True
        got = [model(p, row) for p in parts]
        value = any(got) if kind == "OR" else all(got)
        return value != (negated != (kind == "NOT"))
    column, op, value = tree
    x = {"id": row[0], "v": row[1]}[column]
    if op is Op.IS_NULL:
        return x is None
    if x is None:
        return False
    return {Op.EQ: x == value, Op.NE: x != value, Op.LT: x < value, Op.LE: x <= value, Op.GT: x > value, Op.GE: x >= value, Op.IN: x in (value, 9), Op.NOT_IN: x not in (value, 9)}[op]


def build(q, tree):
    if isinstance(tree[2], list):
        q = q.group_start(tree[0], tree[1])
        for p in tree[2]:
            q = build(q, p)
        return q.group_end()
    column, op, value = tree
    return q.where(column, op, [value, 9] if op in (Op.IN, Op.NOT_IN) else value)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREE)
def test_random_trees(rows, tree):
    assert ids(build(query(), tree), rows) == [r[0] for r in ROWS if model(tree, r)]
