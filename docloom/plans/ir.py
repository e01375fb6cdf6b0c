"""Plan graphs of retrieval steps, their validation, and their lowering to an executable sequence."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

# Operations a plan may use.
OPERATIONS = (
    "bm25_node.search", "dense_node.search", "hybrid.search", "table_index.search", "chart_index.search", "toc_anchor.locate", "page_locator.locate",
    "figure_finder.find_regions", "chart_screener.screen", "structure.expand", "structure.children", "extract.column", "extract.chart_read_axis",
    "extract.regex", "compute.filter", "compute.eval", "pack.mmr_knapsack", "vlm.answer",
)
# Older names of operations, and the order of stages by evidence hint.
ALIASES = {"dense_search": "dense_node.search", "sparse_search": "bm25_node.search", "hybrid_search": "hybrid.search", "bm25_search": "bm25_node.search"}
ORDER = {"table": ("table", "graphics", "text"), "graphics": ("graphics", "table", "text"), "layout": ("layout", "text"), "text": ("text", "table", "graphics")}
MOST_STAGES, MOST_NODES = 2, 6


class PlanError(ValueError):
    """A plan that cannot be run."""


@dataclass(frozen=True)
class Node:
    """One step: an operation with arguments; ``save_as`` names its result for later steps."""

    op: str
    args: dict[str, Any] = field(default_factory=dict)
    save_as: str | None = None
    uses: tuple[str, ...] = ()


@dataclass(frozen=True)
class Stage:
    """Steps towards one kind of evidence; ``run_if`` is ``name comparator number`` or empty; ``step_ids`` chooses steps."""

    name: str
    evidence: str
    nodes: tuple[Node, ...]
    run_if: str = ""
    k_nodes: int = 50
    step_ids: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    stages: tuple[Stage, ...]
    constraints: dict[str, Any] = field(default_factory=dict)


def validate(plan: Plan) -> Plan:
    """The plan with current operation names; an error for too many stages or steps, or an unknown operation."""
    if not 1 <= len(plan.stages) <= MOST_STAGES:
        raise PlanError(f"a plan has 1 to {MOST_STAGES} stages, not {len(plan.stages)}")
    stages, names = [], set()
    for stage in plan.stages:
        if not 1 <= len(stage.nodes) <= MOST_NODES:
            raise PlanError(f"stage {stage.name} has {len(stage.nodes)} steps; 1 to {MOST_NODES} are allowed")
        nodes = []
        for i, node in enumerate(stage.nodes):
            op = ALIASES.get(node.op, node.op)
            if op not in OPERATIONS:
                raise PlanError(f"unknown operation {node.op}")
            missing = [u for u in node.uses if u not in names]
            if missing:
                raise PlanError(f"{op} uses {missing[0]}, which no earlier step saves")
            name = node.save_as or f"{stage.name}_{i}"
            names.add(name)
            nodes.append(replace(node, op=op, save_as=name))
        stages.append(replace(stage, nodes=tuple(nodes)))
    return replace(plan, stages=tuple(stages))


def lower(plan: Plan) -> Plan:
    """Add what every plan gets: a pack step at the end of a stage that returns hits, and a stage of chart
    search, run if coverage stays under one half, to a plan of tables alone."""
    plan = validate(plan)
    stages = [_packed(s) for s in plan.stages]
    if len(stages) == 1 and stages[0].evidence == "table":
        keys = next((n.args.get("keywords") or n.args.get("columns") for n in stages[0].nodes if n.op == "table_index.search"), None)
        chart = Node("chart_index.search", {"keywords": keys or ()}, "chart_fallback")
        stages.append(_packed(Stage("chart_fallback", "graphics", (chart,), "prev_coverage < 0.5")))
    return replace(plan, stages=tuple(stages))


def _packed(stage: Stage) -> Stage:
    last = stage.nodes[-1]
    if last.op.split(".")[0] in ("pack", "compute", "extract", "vlm"):
        return stage
    return replace(stage, nodes=(*stage.nodes, Node("pack.mmr_knapsack", {"limit": stage.k_nodes}, f"{stage.name}_pack", (last.save_as,))))


def should_run(condition: str, facts: dict[str, float]) -> bool:
    """Whether ``name comparator number`` holds; what cannot be read counts as true."""
    found = re.fullmatch(r"\s*(\w+)\s*(<=|>=|==|!=|<|>)\s*(\S+)\s*", condition or "")
    if not found or found[1] not in facts:
        return True
    try:
        right = float(found[3])
    except ValueError:
        return True
    left = facts[found[1]]
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right, "!=": left != right}[found[2]]


def order_stages(stages: list[Stage], hint: str | None) -> list[Stage]:
    """Stages with the hinted evidence first; others keep their order."""
    order = ORDER.get(hint or "", ())
    return sorted(stages, key=lambda s: order.index(s.evidence) if s.evidence in order else len(order))


def from_json(raw: dict) -> Plan:
    """A plan from its JSON form, with missing parts defaulted."""
    stages = []
    for i, s in enumerate(raw.get("stages") or []):
        nodes = tuple(Node(str(n.get("op") or ""), dict(n.get("args") or {}), n.get("save_as") or n.get("id"), tuple(n.get("uses") or ())) for n in s.get("graph") or s.get("nodes") or [])
        stages.append(Stage(str(s.get("name") or f"stage_{i}"), str(s.get("evidence_type") or "text"), nodes, str(s.get("run_if") or ""), int((s.get("params") or {}).get("k_nodes") or 50), tuple(str(x) for x in s.get("step_ids") or () if x)))
    return Plan(tuple(stages), dict(raw.get("constraints") or {}))


def select_plan(plans: list[Plan], mode: str = "first") -> Plan:
    """One of several candidate plans; only ``first`` is a way to choose."""
    if not plans:
        raise PlanError("there is no plan to choose from")
    if mode != "first":
        raise PlanError(f"unknown way to choose a plan: {mode}")
    return plans[0]


def chosen_steps(stage: Stage) -> tuple[Node, ...]:
    """The steps that a stage's ``step_ids`` name; all, if it names none or none of its steps."""
    named = tuple(n for n in stage.nodes if n.save_as in stage.step_ids)
    return named or stage.nodes


def action_of(node: Node) -> str:
    """What a step does: ``retrieve`` finds nodes, ``move`` goes on from nodes, ``read`` takes values, ``compute``, ``pack`` or ``answer``."""
    family, _, verb = ALIASES.get(node.op, node.op).partition(".")
    if family in ("structure", "chart_screener"):
        return "move"
    return {"extract": "read", "compute": "compute", "pack": "pack", "vlm": "answer"}.get(family, "retrieve" if verb in ("search", "locate", "find_regions") else "read")


def repair(plan: Plan, outcomes: dict[str, list], query: str) -> Plan | None:
    """What to run after a plan without result: the stages that failed or found nothing, as one wide text search.

    None if a text search is what has failed, for then nothing wider is left.
    """
    tried = {ALIASES.get(n.op, n.op) for s in plan.stages for n in s.nodes}
    if "hybrid.search" in tried or not query.strip():
        return None
    op = "hybrid.search" if "bm25_node.search" in tried else "bm25_node.search"
    if all(o.status == "ok" for found in outcomes.values() for o in found) and "bm25_node.search" in tried:
        op = "hybrid.search"
    return lower(Plan((Stage("repair", "text", (Node(op, {"query": query, "k": 50}, "repaired"),)),), dict(plan.constraints)))
