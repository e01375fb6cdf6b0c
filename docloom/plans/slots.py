"""Model-dependent steps as callables with deterministic defaults.

A slot takes and returns plain values on the driver, or a batch in an Arrow function; nothing here
needs a network. Pass your own callable to use a model.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.router import plan, route


def answer_from(rows: list[dict]) -> dict:
    """Default reasoner: the computed result if there is one, else the best evidence's text, else no answer."""
    for row in rows:
        if row.get("result") is not None:
            return {"answer": f"{row['result']:g}" if isinstance(row["result"], float) else str(row["result"]), "confidence": 0.8}
    for row in rows:
        if row.get("content"):
            return {"answer": str(row["content"])[:280], "confidence": 0.4}
    return {"answer": "Not answerable", "confidence": 0.0}


def judge(answer: dict, n_evidence: int) -> dict:
    """Default judge: passes an answer that has evidence, by its confidence."""
    good = answer["answer"] not in ("", "Not answerable") and n_evidence > 0
    return {"passed": good, "score": answer["confidence"] if good else 0.0, "issues": [] if good else ["no evidence"]}


def merge_verdicts(verdicts: list[dict]) -> dict:
    """One verdict of several: passed if none is fatal and any passes; issues united; the strictest advice."""
    rank = ["accept", "retry", "replan", "abort"]
    fatal = [i for v in verdicts for i in v.get("issues", []) if str(i).startswith("fatal")]
    advice = max((v.get("recommendation", "accept") for v in verdicts), key=lambda r: rank.index(r) if r in rank else 0, default="accept")
    return {"passed": not fatal and any(v["passed"] for v in verdicts), "score": max((v["score"] for v in verdicts), default=0.0), "issues": list(dict.fromkeys(i for v in verdicts for i in v.get("issues", []))), "recommendation": advice}


def parse_ranking(raw: str) -> dict[str, float]:
    """Scores by node from a ranker's JSON: ``results``, ``hits`` or ``result``; base ids win; clamped to 0..1."""
    try:
        found = json.loads(raw)
    except ValueError:
        inner = re.search(r"\{.*\}", raw or "", re.S)
        try:
            found = json.loads(inner[0]) if inner else {}
        except ValueError:
            found = {}
    rows = next((found[k] for k in ("results", "hits", "result") if isinstance(found.get(k), list)), []) if isinstance(found, dict) else []
    out: dict[str, float] = {}
    for row in rows:
        name = row.get("base_id") or row.get("node_id") if isinstance(row, dict) else None
        if name:
            out[str(name)] = max(0.0, min(1.0, float(row.get("score") or 0.0)))
    return out


def render(template: str, **values: Any) -> str:
    """A prompt with ``{name}`` replaced; other braces stay."""
    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


@dataclass
class Slots:
    """All slots of a question's run."""

    route: Callable = route
    plan: Callable = plan
    reason: Callable[[list[dict]], dict] = answer_from
    judge: Callable[[dict, int], dict] = judge
    encode: Callable[[str], list[float]] | None = None


def describe_media(media: DataFrame, describe: Callable[[list[bytes]], list[dict]], *, override: bool = False) -> DataFrame:
    """Fill ``description`` and ``caption`` of media (content binary) by a model, in batches.

    Fields that have a value stay unless ``override``.
    """

    @F.pandas_udf("description string, caption string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = describe(list(batch))
            yield pd.DataFrame({"description": [f.get("description") for f in found], "caption": [f.get("caption") for f in found]})

    told = media.withColumn("told", run("content"))
    pick = lambda c: F.when(F.lit(override) | F.col(c).isNull() | (F.col(c) == ""), F.coalesce(f"told.{c}", c)).otherwise(F.col(c))
    return told.withColumn("description", pick("description")).withColumn("caption", pick("caption")).drop("told")
