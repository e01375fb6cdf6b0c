"""Queries of filters, ranks, aggregates and set operations over order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import compute, graph
from docloom.queries.base import Family, table

FAMILY = Family()


def _rows(spark, sf_dir):
    """Order lines as extracted cells: value as text, unit sometimes missing, year of shipment."""
    k = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")
    unit = F.when(F.col("l_suppkey") % 3 == 0, "%").when(F.col("l_suppkey") % 3 == 1, "ms")
    return table(spark, sf_dir, "lineitem").select(k.alias("ord"), F.concat(F.lit("n"), F.col("l_partkey")).alias("node_id"), F.col("l_returnflag").alias("label"), F.format_string("%.2f", "l_extendedprice").alias("value"), unit.alias("unit"), F.when(F.col("l_suppkey") % 5 > 0, F.year("l_shipdate").cast("long")).alias("year"))


_ROWS = "rows_ AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS ord, 'n' || l_partkey AS node_id, l_returnflag AS label, printf('%.2f', l_extendedprice) AS value, CASE l_suppkey % 3 WHEN 0 THEN '%' WHEN 1 THEN 'ms' END AS unit, CASE WHEN l_suppkey % 5 > 0 THEN year(l_shipdate) END AS year FROM lineitem)"


@FAMILY.add(f"WITH {_ROWS} SELECT ord, node_id, value FROM rows_ WHERE value::DOUBLE >= 30000 AND coalesce(unit = '%', true) AND coalesce(year = 1995, true)")
def compute_filter(spark, sf_dir):
    """Cells over a threshold, of one unit and year where they say."""
    return compute.compare(_rows(spark, sf_dir), 30000, ">=", unit="%", year=1995).select("ord", "node_id", "value")


@FAMILY.add(f"WITH {_ROWS}, fit AS (SELECT ord, value::DOUBLE AS v FROM rows_ WHERE coalesce(unit = 'ms', true)), t AS (SELECT v FROM fit ORDER BY v DESC LIMIT 1 OFFSET 6) SELECT ord, v AS value FROM fit WHERE v = (SELECT v FROM t)")
def compute_rank(spark, sf_dir):
    """All cells with the seventh largest value."""
    return compute.rank(_rows(spark, sf_dir), 7, unit="ms").select("ord", F.col("value").cast("double").alias("value"))


@FAMILY.add(f"WITH {_ROWS} SELECT node_id, value, label, year, min(ord) AS ord FROM rows_ GROUP BY ALL")
def compute_records(spark, sf_dir):
    """Distinct numeric records, each by its first occurrence."""
    return compute.numeric_records(_rows(spark, sf_dir)).select("node_id", "value", "label", "year", "ord")


_OPS = ("sum", "avg", "max", "min", "count", "range", "first", "last")


@FAMILY.add(
    f"""WITH {_ROWS} SELECT label, round(sum(v), 2) AS "sum", round(avg(v), 4) AS "avg", max(v) AS "max", min(v) AS "min", count(v)::DOUBLE AS "count", round(max(v) - min(v), 4) AS "range", arg_min(v, ord) AS "first", arg_max(v, ord) AS "last" FROM (SELECT *, value::DOUBLE AS v FROM rows_) GROUP BY label"""
)
def compute_eval(spark, sf_dir):
    """Every aggregate by label."""
    records = _rows(spark, sf_dir).withColumn("number", F.col("value").cast("double"))
    out = None
    for op in _OPS:
        digits = {"sum": 2, "avg": 4, "range": 4}.get(op)
        one = compute.evaluate(records, op, digits=digits, by=("label",)).select("label", F.col("result").alias(op))
        out = one if out is None else out.join(one, "label")
    return out


@FAMILY.add(f"WITH {_ROWS} SELECT count(DISTINCT node_id)::DOUBLE AS result, 'unique' AS op FROM rows_ UNION ALL SELECT count(DISTINCT node_id)::DOUBLE, 'count' FROM rows_ UNION ALL SELECT round(avg(value::DOUBLE), 4), 'avg' FROM rows_ UNION ALL SELECT 1.0, 'exists' FROM rows_ HAVING count(*) > 0")
def compute_plan_aggregates(spark, sf_dir):
    """Aggregates of plan steps."""
    rows = _rows(spark, sf_dir)
    each = [compute.plan_aggregate(rows, "unique", "node_id"), compute.plan_aggregate(rows, "count", dedup_by="node_id"), compute.plan_aggregate(rows, "avg", "value").withColumn("result", F.round("result", 4)), compute.plan_aggregate(rows, "exists")]
    names = ["unique", "count", "avg", "exists"]
    out = [e.select("result", F.lit(n).alias("op")) for e, n in zip(each, names, strict=True)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@FAMILY.add("SELECT c_custkey AS node_id, c_acctbal AS score FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) ORDER BY c_acctbal DESC, c_custkey LIMIT 6")
def unseen_hits(spark, sf_dir):
    """The first six hits that were not visited."""
    hits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_acctbal").alias("score"))
    visited = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("node_id"))
    return graph.unseen(hits, visited)


@FAMILY.add("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def distinct_in_order(spark, sf_dir):
    """The first event of each user."""
    return graph.distinct_in_order(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@FAMILY.add(
    """SELECT coalesce(event_type, 'all') AS event_type, coalesce(k::VARCHAR, 'all') AS k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, (props->>'$.k')::BIGINT % 5 AS k FROM events) GROUP BY ROLLUP (event_type, k)"""
)
def event_rollup(spark, sf_dir):
    """Events by type and a JSON property, with subtotals."""
    k = F.pmod(F.from_json("props", "k long")["k"], F.lit(5))
    rows = table(spark, sf_dir, "events").select("event_type", "value", k.alias("k"))
    out = rows.rollup("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce(F.col("k").cast("string"), F.lit("all")).alias("k"), "n", "total")
