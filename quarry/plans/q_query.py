"""Queries of the builder: projections, predicates, sorts, limits, aggregates, distinct."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.predicates import register_predicate

from .query import Condition, Group, Query, query
from .registry import load, register

LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
LINE_SQL = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
PART_SQL = "SELECT p_partkey, p_name FROM part WHERE "
ORDER_SQL = "SELECT o_orderkey, o_orderpriority FROM orders WHERE "


def _built(name: str, table: str, plan: Query, sql: str) -> None:
    register(name, sql)(lambda spark, sf_dir: plan.execute(load(spark, sf_dir, table)))


def _filters() -> None:
    line, part, order = query("lineitem").select(*LINE), query("part").select("p_partkey", "p_name"), query("orders").select("o_orderkey", "o_orderpriority")
    for name, plan, sql in [
        ("flt_eq", line.where_eq("l_returnflag", "R"), "l_returnflag = 'R'"),
        ("flt_ne", line.where_ne("l_returnflag", "R"), "l_returnflag <> 'R'"),
        ("flt_lt", line.where_lt("l_quantity", 10), "l_quantity < 10"),
        ("flt_le", line.where_le("l_quantity", 10), "l_quantity <= 10"),
        ("flt_gt", line.where_gt("l_quantity", 40), "l_quantity > 40"),
        ("flt_ge", line.where_ge("l_quantity", 40), "l_quantity >= 40"),
        ("flt_in", line.where_in("l_linenumber", [1, 3, None]), "l_linenumber IN (1, 3)"),
        ("flt_not_in", line.where_not_in("l_returnflag", ["A", None]), "l_returnflag NOT IN ('A')"),
        ("flt_between", line.where_between("l_quantity", 10, 20), "l_quantity BETWEEN 10 AND 20"),
        ("flt_null", line.where_null("l_returnflag"), "l_returnflag IS NULL"),
        ("flt_not_null", line.where_not_null("l_returnflag"), "l_returnflag IS NOT NULL"),
        ("flt_unknown_column", line.where_eq("no_such_column", 1), "false"),
        ("flt_and", line.where_gt("l_quantity", 10).and_where("l_returnflag", "=", "A"), "l_quantity > 10 AND l_returnflag = 'A'"),
        ("flt_or", line.where_gt("l_quantity", 48).where_eq("l_returnflag", "A").or_where("l_linenumber", "=", 7), "l_quantity > 48 OR l_returnflag = 'A' OR l_linenumber = 7"),
        (
            "flt_group",
            line.where_gt("l_quantity", 10).group_start("OR").where_eq("l_returnflag", "A").group_start("AND").where_eq("l_linenumber", 2).where_lt("l_tax", 0.03).group_end().group_end(),
            "l_quantity > 10 AND (l_returnflag = 'A' OR (l_linenumber = 2 AND l_tax < 0.03))",
        ),
        ("flt_not", line.group_start("NOT").where_gt("l_quantity", 10).where_eq("l_returnflag", "A").group_end(), "NOT (coalesce(l_quantity > 10 AND l_returnflag = 'A', false))"),
        ("flt_negated", line.group_start("OR", negated=True).where_gt("l_quantity", 5).where_eq("l_returnflag", "N").group_end(), "NOT (coalesce(l_quantity > 5 OR l_returnflag = 'N', false))"),
        ("flt_any_of", line.any_of(Condition("l_linenumber", "=", 1), Group("AND", parts=(Condition("l_tax", ">", 0.05), Condition("l_discount", "<", 0.02)))), "l_linenumber = 1 OR (l_tax > 0.05 AND l_discount < 0.02)"),
        ("flt_number_from_text", line.where_ge("l_quantity", "45"), "l_quantity >= 45"),
        ("flt_number_unparsable", line.where_ne("l_quantity", "1e5x"), "l_quantity IS NOT NULL"),
    ]:
        _built(name, "lineitem", plan, LINE_SQL + sql)
    for name, plan, sql in [
        ("flt_like", part.where_like("p_name", "%A_%1%"), "p_name ILIKE '%A_%1%'"),
        ("flt_not_like", part.where("p_name", "NOT LIKE", "%1%"), "p_name NOT ILIKE '%1%'"),
        ("flt_contains", part.where_contains("p_name", "1"), "contains(p_name, '1')"),
        ("flt_contains_number", part.where_contains("p_size", "1"), "contains(p_size::VARCHAR, '1')"),
        ("flt_starts_with", part.where_starts_with("p_name", "Part"), "starts_with(p_name, 'Part')"),
        ("flt_ends_with", part.where_ends_with("p_name", "7"), "ends_with(p_name, '7')"),
        ("flt_regex", part.where_regex("p_name", "[13]+5"), "regexp_matches(p_name, '[13]+5')"),
    ]:
        _built(name, "part", plan, PART_SQL + sql)
    for name, plan, sql in [
        ("flt_operator_text", order.where("o_orderstatus", "in", ["F", "O"]), "o_orderstatus IN ('F', 'O')"),
    ]:
        _built(name, "orders", plan, ORDER_SQL + sql)


_filters()


@register("flt_text_number_coercion", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS code FROM orders WHERE coalesce(try_cast(split_part(o_orderpriority, '-', 1) AS DOUBLE) >= 3, false)")
def text_number(spark, sf_dir):
    """A text column against a number: parsed where it can be."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("code"))
    return query().where_ge("code", 3).execute(orders)


@register("flt_registered", "SELECT p_partkey, p_name FROM part WHERE p_size % 7 = 3")
def registered(spark, sf_dir):
    """A predicate of the caller's."""
    register_predicate("REST OF 7", lambda column, value: column % 7 == value)
    return query().select("p_partkey", "p_name").where("p_size", "rest of 7", 3).execute(load(spark, sf_dir, "part"))


@register("flt_exists", "SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity > 49")
def exists(spark, sf_dir):
    return query().where_gt("l_quantity", 49).execute(load(spark, sf_dir, "lineitem")).limit(1).agg((F.count("*") > 0).alias("found"))


@register("flt_find_one", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 1")
def find_one(spark, sf_dir):
    return query().select("c_custkey", "c_name").where_eq("c_nationkey", 3).order_by("c_custkey").limit(1).execute(load(spark, sf_dir, "customer"))


_ORDERS = query("orders").select("o_orderkey", "o_totalprice")
for _name, _plan, _sql in [
    ("srt_asc", _ORDERS.order_by_asc("o_totalprice").order_by_asc("o_orderkey").limit(50), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50"),
    ("srt_desc", _ORDERS.order_by_desc("o_totalprice").order_by_asc("o_orderkey").limit(50), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    ("srt_multi", query().select("o_orderkey", "o_orderstatus").order_by("o_orderstatus", "desc").order_by("o_orderkey").limit(40), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 40"),
    ("srt_limit_zero", _ORDERS.limit(0), "SELECT o_orderkey, o_totalprice FROM orders LIMIT 0"),
    ("srt_offset", _ORDERS.order_by("o_orderkey").offset(100).limit(20), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100"),
    ("srt_page", _ORDERS.order_by("o_orderkey").paginate(3, 25), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50"),
    ("set_distinct", query().select("o_orderstatus", "o_orderpriority").distinct(), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    ("set_distinct_after_limit", query().select("o_orderstatus").order_by("o_orderkey").limit(30).distinct(), "SELECT DISTINCT o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 30)"),
    ("prj_columns", _ORDERS.where_lt("o_orderkey", 200), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 200"),
    ("agg_group_keys_only", query().group_by("o_orderstatus"), "SELECT DISTINCT o_orderstatus FROM orders"),
    ("agg_count_all", query().count(alias="n"), "SELECT count(*) AS n FROM orders"),
    ("agg_count_column", query().count("o_orderstatus", "n"), "SELECT count(o_orderstatus) AS n FROM orders"),
    ("agg_default_alias", query().group_by("o_orderstatus").count().max("o_orderkey"), 'SELECT o_orderstatus, count(*) AS "COUNT_*", max(o_orderkey) AS "MAX_o_orderkey" FROM orders GROUP BY o_orderstatus'),
    ("agg_min_max", query().group_by("o_orderpriority").min("o_totalprice", "low").max("o_totalprice", "high"), "SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1"),
    ("agg_sum_long", query().group_by("o_orderstatus").sum("o_custkey", "total"), "SELECT o_orderstatus, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1"),
    ("agg_avg_long", query().group_by("o_orderstatus").avg("o_custkey", "mean"), "SELECT o_orderstatus, avg(o_custkey) AS mean FROM orders GROUP BY 1"),
    ("agg_global_none", query().where_lt("o_orderkey", -1).count(alias="n").sum("o_custkey", "total").avg("o_custkey", "mean").min("o_orderkey", "low").max("o_orderkey", "high"), "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS total, avg(o_custkey) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE o_orderkey < -1"),
    ("agg_sorted", query().group_by("o_custkey").count(alias="n").order_by_desc("n").order_by("o_custkey").limit(25), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 25"),
]:
    _built(_name, "orders", _plan, _sql)
_built("prj_all", "nation", query().select_all(), "SELECT * FROM nation")
_built("prj_unknown_column", "nation", query().select("n_nationkey").where_ge("n_nationkey", 0), "SELECT n_nationkey FROM nation")


@register(
    "agg_grouped",
    "SELECT l_returnflag, count(*) AS n, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS quantity, min(l_shipdate)::DATE::VARCHAR AS first_day FROM lineitem "
    "WHERE l_quantity > 10 AND l_returnflag IN ('A', 'R') GROUP BY l_returnflag",
)
def grouped(spark, sf_dir):
    """Filter, group and aggregate in one plan; sums in decimals do not depend on the order of rows."""
    lines = load(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("decimal(18,2)"))
    plan = query("lineitem").where_gt("l_quantity", 10).where_in("l_returnflag", ["A", "R"]).group_by("l_returnflag")
    out = plan.count(alias="n").sum("q", "quantity").min("l_shipdate", "first_day").execute(lines)
    return out.withColumn("quantity", F.col("quantity").cast("double")).withColumn("first_day", F.col("first_day").cast("date").cast("string"))


@register(
    "agg_null_groups",
    "SELECT k, count(*) AS n, count(v) AS n_v, sum(v)::BIGINT AS total FROM (SELECT nullif(o_custkey % 5, 0) AS k, nullif(o_orderkey % 3, 0) AS v FROM orders) GROUP BY k",
)
def null_groups(spark, sf_dir):
    """A null key is a group, null values are not counted."""
    orders = load(spark, sf_dir, "orders").select(F.expr("nullif(o_custkey % 5, 0)").alias("k"), F.expr("nullif(o_orderkey % 3, 0)").alias("v"))
    return query().group_by("k").count(alias="n").count("v", "n_v").sum("v", "total").execute(orders)


@register("srt_nulls", "SELECT k, o_orderkey FROM (SELECT nullif(o_custkey % 5, 0) AS k, o_orderkey FROM orders) ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 30")
def sorted_nulls(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.expr("nullif(o_custkey % 5, 0)").alias("k"), "o_orderkey")
    return query().order_by_desc("k").order_by("o_orderkey").limit(30).execute(orders)


@register("srt_page_count", "SELECT greatest(1, ceil(count(*) / 7.0))::BIGINT AS pages, least(greatest(1, 99999), greatest(1, ceil(count(*) / 7.0)))::BIGINT AS page FROM nation")
def page_count(spark, sf_dir):
    """Total pages, and a page beyond the last clamped to it."""
    pages = F.greatest(F.lit(1), F.ceil(F.count("*") / 7)).cast("long")
    return load(spark, sf_dir, "nation").agg(pages.alias("pages"), F.least(F.lit(99999), pages).cast("long").alias("page"))
