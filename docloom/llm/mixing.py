"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule: a piecewise linear function of training time from 0 to 1. Its
integral gives the source's share of the words to be taken; shares beyond ``max_epochs`` passes over a
source are dealt again to the others in proportion to their weights. The source's cumulative demand
of words is the target times the normalised integral of its schedule, so the training time of the
document at word offset c of its source is the inverse of that demand at c. Documents are then range
sorted by training time.

Everything is DataFrame code. The running word offsets inside a source are found in two steps, so
that a source of any size is spread over many tasks: sums of narrow hash ranges first, offsets inside
a range after. Sources, not documents, are the only thing whose full list meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import hash32, materialise, n_words, power_of_two

Knots = tuple[tuple[float, float], ...]

#: Schedules by rank of the source, repeating: (training time, weight). Their integrals are 5, 2 and 1:
#: the heaviest sources lead early, the lightest are stressed towards the end.
CURRICULUM: tuple[Knots, ...] = (((0.0, 6.25), (1.0, 3.75)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))


def integral(knots: Knots) -> float:
    """Area under a piecewise linear schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def _segments(knots: Knots) -> Column:
    """The schedule's pieces, scaled to area 1: start, width, weights at both ends, area before."""
    total, before, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("dt", t1 - t0), ("w0", w0 / total), ("w1", w1 / total), ("a0", before)))))
        before += (t1 - t0) * (w0 + w1) / 2 / total
    return F.array(*out)


def _time_of(share: Column, segments: Column) -> Column:
    """Training time at which ``share`` of a source's demand has been met."""
    s = F.element_at(F.filter(segments, lambda s: s["a0"] <= F.greatest(share, F.lit(0.0))), -1)
    slope = (s["w1"] - s["w0"]) / s["dt"]
    rest = share - s["a0"]
    curved = (F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * slope * rest)) - s["w0"]) / slope
    return s["t0"] + F.when(slope == 0, rest / s["w0"]).otherwise(curved)


def source_targets(sums: DataFrame, *, ratio: float, max_epochs: int, schedules: tuple[Knots, ...]) -> DataFrame:
    """``skey, source_size, target, rank`` from ``skey, source, source_size``, one row per source.

    Water filling in closed form: with sources in order of cap / weight, the level at a source is what
    is left after capping all before it, divided by the weight left; the level that holds is the
    highest. It equals dealing the excess again until no target is above its cap.
    """
    weights = F.array(*(F.lit(float(integral(k))) for k in schedules))
    everyone = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sums.withColumn("rank", (F.row_number().over(everyone) - 1).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("rank") % len(schedules) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("long"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.lit(float(ratio)) * F.sum("source_size").over(whole)
    left = wanted - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = ranked.withColumn("level", left / weight_left)
    levelled = levelled.withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight")))
    return levelled.select("skey", "source_size", "target", "rank")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *payload: Column) -> DataFrame:
    source = F.col(source_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("skey"),
        n_words(F.col(text_col)).alias("size"),
        hash32(F.col(id_col)).alias("h"),
        *payload,
    )


def _assign(rows: DataFrame, sizes: DataFrame, *, ratio: float, max_epochs: int, schedules: tuple[Knots, ...]) -> DataFrame:
    """Add ``source_size, target, copies, taken, times`` to ``rows``; ``sizes`` is the same table without payload."""
    n = sizes.count()
    bits = power_of_two(n, 64, 1 << 20).bit_length() - 1
    part = F.shiftright("h", 32 - bits)
    sums = sizes.groupBy("skey", part.alias("part")).agg(F.sum("size").alias("words"))
    sums = materialise(sums, "mix-sums")
    totals = sums.groupBy("skey").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("skey") != "n", F.substring("skey", F.lit(2), F.length("skey"))))
    targets = source_targets(totals, ratio=ratio, max_epochs=max_epochs, schedules=schedules)
    running = Window.partitionBy("skey").orderBy("part")
    starts = sums.select("skey", "part", (F.sum("words").over(running) - F.col("words")).alias("start")).join(targets, "skey")
    inside = Window.partitionBy("skey", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("part", part).withColumn("upto", F.sum("size").over(inside)).join(materialise(starts, "mix-starts"), ["skey", "part"])
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    passes = F.floor((F.col("target") - middle) / F.nullif(F.col("source_size"), F.lit(0))) + 1
    copies = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(max_epochs), passes))).cast("int")
    kinds = F.array(*(_segments(k) for k in schedules))
    segments = F.element_at(kinds, (F.col("rank") % len(schedules) + 1).cast("int"))
    times = F.transform(
        F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>")),
        lambda p: _time_of((F.col("middle") + p * F.col("source_size")) / F.col("target"), segments),
    )
    return placed.withColumn("middle", middle).withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).withColumn("times", times)


def plan_mix(
    docs: DataFrame,
    *,
    ratio: float = 1.5,
    max_epochs: int = 2,
    schedules: tuple[Knots, ...] = CURRICULUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often, and when, the mix takes each document.

    Returns one row per document: ``doc_id, source, size, source_size, target, copies, taken, times``
    (``times`` has the training time of each copy), in training order; documents that are not taken
    come last. A document's size is its number of words, 0 for a null or empty text; such documents
    are never taken. A null source is a source of its own, after all others. Documents of a source are
    met in the order of a hash of their id, so equal ids (repeated rows) are neighbours, and reruns
    agree. A source's taken words differ from its target by at most half its largest document.
    An empty table gives an empty result.
    """
    sizes = materialise(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    out = _assign(sizes, sizes, ratio=ratio, max_epochs=max_epochs, schedules=schedules)
    first = F.try_element_at("times", F.lit(1))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "times").orderBy(first.asc_nulls_last(), "doc_id")


def training_order(
    docs: DataFrame,
    *,
    ratio: float = 1.5,
    max_epochs: int = 2,
    schedules: tuple[Knots, ...] = CURRICULUM,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed corpus: every column of ``docs``, one row per copy taken, range sorted by training time."""
    sizes = materialise(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    whole = _sized(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = _assign(whole, sizes, ratio=ratio, max_epochs=max_epochs, schedules=schedules)
    return out.select("row", "doc_id", F.explode("times").alias("time")).orderBy("time", "doc_id").select("row.*")
