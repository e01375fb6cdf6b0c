"""Scores of answers, and reports over scored samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

UNANSWERABLE = "Not answerable"


def anls(a: Column, b: Column, *, threshold: float = 0.5) -> Column:
    """Average normalised Levenshtein similarity; 0 up to the threshold, 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    value = F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))
    return F.when(value <= threshold, 0.0).otherwise(value)


def clean_answer(c: Column) -> Column:
    """Lower-cased answer without unit words, parentheses, outer quotes, dollar and percent signs."""
    s = F.trim(F.lower(T.text(c)))
    for suffix in ("mile", "miles", "million"):
        s = F.trim(F.regexp_replace(s, f"{suffix}$", ""))
    s = F.trim(F.regexp_replace(s, r"\s*\([^)]*\)", ""))
    s = F.trim(F.regexp_replace(s, r"^['\"]|['\"]$", ""))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"^\$+", "")), r"%+$", ""))


def must_match_exactly(s: Column) -> Column:
    """Answers for which near is not enough: links, files, pages, number ranges, times, dates, addresses."""
    rules = [r"https://", r"\.py$|ipynb$", r"^page", r"^\d+(-\d+|\s\d+)?$", r"a\.m\.|p\.m\.", r"^\d{4}[-\s]\d{2}[-\s]\d{2}$", r"^\d{4}[-\s]\d{2}$", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"]
    return reduce(lambda a, b: a | b, [s.rlike(r) for r in rules])


def as_double(c: Column) -> Column:
    return T.to_number(F.regexp_replace(T.text(c), ",", "x"))


def float_equal(reference: Column, prediction: Column) -> Column:
    """Equal within a percent, where either may be written in percents."""
    close = lambda x: F.abs(x - prediction) <= 0.01 * F.greatest(F.abs(x), F.abs(prediction))
    same = lambda x: F.round(x, 2) == F.round(prediction, 2)
    options = [reference / 100, reference, reference * 100]
    return F.coalesce(reduce(lambda a, b: a | b, [close(x) | same(x) for x in options]), F.lit(False))


def answer_score(gold: Column, pred: Column, kind: Column) -> Column:
    """Score 0 to 1 of an answer by its type: Int, Float, Str or None, and anything else as a list."""
    return (
        F.when(kind == "Int", T.let(F.struct(gold.alias("g"), as_double(gold).alias("x"), as_double(pred).alias("y")), _int_score))
        .when(kind == "Float", T.let(F.struct(as_double(clean_answer(gold)).alias("x"), as_double(clean_answer(pred)).alias("y")), lambda v: float_equal(v["x"], v["y"]).cast("double")))
        .when(kind.isin("Str", "None"), T.let(F.struct(clean_answer(gold).alias("g"), clean_answer(pred).alias("p")), _text_score))
        .otherwise(T.let(F.struct(_items(gold).alias("g"), _items(pred).alias("p")), _list_score))
    )


def _int_score(v: Column) -> Column:
    whole = T.text(v["g"]).rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(whole & v["y"].isNotNull() & (v["x"].cast("long") == v["y"].cast("long")), 1.0).otherwise(0.0)


def _text_score(v: Column) -> Column:
    return F.when(must_match_exactly(v["g"]), (v["g"] == v["p"]).cast("double")).otherwise(anls(v["g"], v["p"]))


def _items(c: Column) -> Column:
    return F.array_sort(F.transform(F.when(F.trim(T.text(c)).startswith("["), T.list_literal(c)).otherwise(F.array(T.text(c))), clean_answer))


def _list_score(v: Column) -> Column:
    head = F.coalesce(F.get(v["g"], F.lit(0)), F.lit(""))
    exact = (F.array_join(v["g"], "-") == F.array_join(v["p"], "-")).cast("double")
    least = F.coalesce(F.array_min(F.zip_with(v["g"], v["p"], lambda a, b: anls(a, b))), F.lit(0.0))
    return F.when(F.size(v["g"]) != F.size(v["p"]), 0.0).when(as_double(head).isNotNull() | must_match_exactly(head), exact).otherwise(least)


def accuracy_and_f1(samples: DataFrame, *by: str) -> DataFrame:
    """Mean score, and F1 of recall over answerable and precision over answered samples; ``n`` samples."""
    positive = F.col("answer") != UNANSWERABLE
    hit = F.sum(F.when(positive, F.col("score")).otherwise(0.0))
    recall = F.try_divide(hit, F.count_if(positive))
    precision = F.try_divide(hit, F.count_if(F.col("pred") != UNANSWERABLE))
    out = samples.where("score IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"), recall.alias("recall"), precision.alias("precision"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0)))


def report(samples: DataFrame) -> DataFrame:
    """``section, name, n, accuracy``: overall, single-page, cross-page, unanswerable, by evidence source, by document type.

    Samples have ``evidence_pages`` and ``evidence_sources`` (arrays), ``doc_type, answer, score``.
    """
    pages = F.size(F.coalesce("evidence_pages", F.array().cast("array<int>")))
    tags = F.array(
        F.struct(F.lit("overall").alias("section"), F.lit("all").alias("name")),
        F.when((F.col("answer") != UNANSWERABLE) & (pages == 1), F.struct(F.lit("pages").alias("section"), F.lit("single").alias("name"))),
        F.when((F.col("answer") != UNANSWERABLE) & (pages > 1), F.struct(F.lit("pages").alias("section"), F.lit("cross").alias("name"))),
        F.when(F.col("answer") == UNANSWERABLE, F.struct(F.lit("pages").alias("section"), F.lit("unanswerable").alias("name"))),
        F.when(F.col("doc_type").isNotNull(), F.struct(F.lit("type").alias("section"), F.col("doc_type").alias("name"))),
    )
    sources = F.transform(F.coalesce("evidence_sources", F.array().cast("array<string>")), lambda s: F.struct(F.lit("source").alias("section"), s.alias("name")))
    rows = samples.where("score IS NOT NULL").select("score", F.explode(F.filter(F.concat(tags, sources), lambda t: t.isNotNull())).alias("t"))
    return rows.groupBy("t.section", "t.name").agg(F.count("*").alias("n"), F.avg("score").alias("accuracy"))


def confusion(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    """Counts of each pair of gold and predicted class."""
    return rows.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def format_conforms(answer: Column, spec: str | None) -> Column:
    """1.0 if an answer has one of the asked formats (``int|float|list|string``), else 0.0.

    A blank answer never has; without a format any other has. Numbers may have thousands separators, a float
    percent signs. A list has a line break, semicolon or comma. A format of another name is never met.
    """
    s = F.regexp_replace(T.text(answer), r"^\s+|\s+$", "")
    number = F.trim(F.replace(s, F.lit(","), F.lit("")))
    rules = {
        "int": number.rlike(r"^[+-]?\d+(_\d+)*$"),
        "float": F.trim(F.replace(number, F.lit("%"), F.lit(""))).rlike(r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)$"),
        "list": s.rlike(r"[\n;,]"),
        "string": F.lit(True),
    }
    options = [o.strip() for o in (spec or "").split("|") if o.strip()]
    met = reduce(lambda a, b: a | b, [rules.get(o, F.lit(False)) for o in options]) if options else F.lit(True)
    return ((s != "") & met).cast("double")


def source_priority(hits: DataFrame) -> DataFrame:
    """One row ``priority``: 1.0 with a table among the hits, 0.6 with a figure, 0.3 with anything, else 0."""
    value = F.when(F.col("role") == "table", 1.0).when(F.col("role").isin("image", "figure", "chart"), 0.6).otherwise(0.3)
    return hits.agg(F.coalesce(F.max(value), F.lit(0.0)).alias("priority"))


def quality(coverage: Column, form: Column, judged: Column, source: Column, confidence: Column) -> Column:
    """Weighted quality of an answer."""
    return 0.25 * coverage + 0.15 * form + 0.40 * judged + 0.10 * source + 0.10 * confidence
