"""Answering a question: route, plan, run, observe, reason, judge, and try again if need be."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from docloom.functions.scoring import format_conforms, quality
from docloom.operators import tools
from docloom.operators.keys import key, shared
from docloom.plans.executor import Catalog, Executor, run_plan
from docloom.plans.ir import repair
from docloom.plans.slots import Slots

GIVE_UP = "Insufficient information to answer the question."


@dataclass
class Memory:
    """What a run has done: decisions, plans, visited nodes, answers."""

    decisions: list = field(default_factory=list)
    plans: list = field(default_factory=list)
    #: Keys of nodes that were looked at: ids, after those of their documents where the catalog has several.
    visited: set[tuple[str, ...]] = field(default_factory=set)
    answers: list[dict] = field(default_factory=list)


def ask(question: str, catalog: Catalog, *, slots: Slots | None = None, rounds: int = 2, accept: float = 0.75, memory: Memory | None = None) -> dict:
    """The best answer over at most ``rounds`` plans: ``answer, confidence, quality, passed, evidence``.

    At most six unseen hits are looked at in a round; only these, and single results, reach the driver.
    """
    slots, memory = slots or Slots(), memory or Memory()
    best: dict | None = None
    for _ in range(rounds):
        decision = slots.route(question.strip())
        plan = slots.plan(decision)
        memory.decisions.append(decision)
        memory.plans.append(plan)
        rows, outcomes = run_plan(plan, catalog, Executor())
        if rows is None and (wider := repair(plan, outcomes, question)) is not None:
            memory.plans.append(wider)
            rows, _ = run_plan(wider, catalog, Executor())
        if rows is None:
            break
        seen: list[dict] = []
        if "result" in rows.columns:
            seen = [r.asDict() for r in rows.limit(6).collect()]
        elif catalog.evidence is not None:
            own = shared(rows, catalog.evidence)
            fresh = rows.select(*own, "score" if "score" in rows.columns else F.lit(1.0).alias("score"))
            visited = catalog.evidence.sparkSession.createDataFrame([v for v in memory.visited if len(v) == len(own)], ", ".join(f"{c} string" for c in own))
            seen = [r.asDict() for r in tools.observe(fresh, catalog.evidence, visited).collect()]
        keys = [tuple(r[c] for c in key(rows) if r.get(c)) for r in seen if r.get("node_id")]
        memory.visited.update(keys)
        answer = slots.reason(seen)
        verdict = slots.judge(answer, len(seen))
        form = rows.sparkSession.range(1).select(format_conforms(F.lit(str(answer["answer"])), getattr(decision, "expected", None))).head()[0]
        total = _quality(seen, form, verdict["score"], answer["confidence"])
        outcome = {**answer, "quality": total, "passed": verdict["passed"], "evidence": ["/".join(k) for k in keys]}
        memory.answers.append(outcome)
        if best is None or (outcome["passed"], total) > (best["passed"], best["quality"]):
            best = outcome
        if outcome["passed"] and total >= accept:
            break
        if not seen:
            break
    return best or {"answer": GIVE_UP, "confidence": 0.0, "quality": 0.0, "passed": False, "evidence": []}


def _quality(seen: list[dict], form: float, judged: float, confidence: float) -> float:
    """Quality of an answer; its sources count as in :func:`docloom.functions.scoring.source_priority`."""
    covered = min(1.0, len(seen) / 6)
    kinds = {"table" if "result" in r else r.get("modality") for r in seen}
    source = 1.0 if "table" in kinds else 0.6 if kinds & {"image", "figure", "chart"} else 0.3 if seen else 0.0
    return quality(covered, form, judged, source, confidence)
