"""Whole plans over the tables of parts: every step a DataFrame, the plan one query."""

from __future__ import annotations

from docloom.plans import ir, router
from docloom.plans.executor import Catalog, run_plan
from docloom.queries.base import Family
from docloom.queries.tools import _figure_tokens
from docloom.queries.views import TABLES_SQL, tables

FAMILY = Family()


@FAMILY.add(
    f"""WITH {TABLES_SQL}, r AS (SELECT node_id, unnest(rows_) AS row_ FROM tabs)
SELECT count(*) AS n_values, round(sum(row_[2]::DOUBLE), 2) AS result FROM (SELECT DISTINCT node_id, row_[1] AS label, row_[2] FROM r) q(node_id, label, v), LATERAL (SELECT ['', v] AS row_)"""
)
def plan_sum_prices(spark, sf_dir):
    """Search tables, read their price column, add it up."""
    plan = ir.lower(
        ir.Plan(
            (
                ir.Stage(
                    "table",
                    "table",
                    (
                        ir.Node("table_index.search", {"columns": ("price",)}, "found"),
                        ir.Node("extract.column", {"value_hints": ("price",)}, "cells", ("found",)),
                        ir.Node("compute.filter", {"threshold": 0, "comparator": ">", "unit": "usd"}, "kept", ("cells",)),
                        ir.Node("compute.eval", {"operation": "sum", "round": 2}, "total", ("kept",)),
                    ),
                ),
            )
        )
    )
    rows, _ = run_plan(plan, Catalog(tables=tables(spark, sf_dir)))
    return rows.select("n_values", "result")


@FAMILY.add()
def plan_routed_question(spark, sf_dir):
    """A question routed, planned and run without any model (tested by its parts)."""
    plan = router.plan(router.route("What is the total price in the tables?"))
    rows, _ = run_plan(plan, Catalog(tables=tables(spark, sf_dir), figure_tokens=_figure_tokens(spark, sf_dir)))
    return rows
