"""Queries of answer scores and reports, over labels, benchmark passages and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import scoring as S
from docloom.queries.base import Family, table

FAMILY = Family()


@FAMILY.add(
    """
WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id % 5 = a.item_id % 5),
v AS (SELECT item_id, x, y, 1.0 - levenshtein(x, y) / greatest(length(x), length(y)) AS s FROM p)
SELECT item_id, round(sum(CASE WHEN s <= 0.5 THEN 0 ELSE s END), 6)::DOUBLE AS total FROM v GROUP BY item_id"""
)
def score_anls(spark, sf_dir):
    """Similarity of benchmark passages with those of their class."""
    b = table(spark, sf_dir, "benchmark")
    other = b.select(F.col("text").alias("y"), (F.col("item_id") % 5).alias("k"))
    pairs = b.withColumn("k", F.col("item_id") % 5).join(other, "k")
    return pairs.groupBy("item_id").agg(F.round(F.sum(S.anls(F.col("text"), F.col("y"))), 6).alias("total"))


# Answers: gold is the order's price or clerk-like text; predictions are off for some.
_SAMPLES = """smp AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Int' WHEN 1 THEN 'Float' WHEN 2 THEN 'Str' ELSE 'None' END AS kind,
  CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50)::VARCHAR WHEN 1 THEN printf('%.2f', o_totalprice) WHEN 2 THEN o_orderpriority ELSE 'Not answerable' END AS gold,
  CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 49)::VARCHAR WHEN 1 THEN printf('%.2f%%', o_totalprice * (1 + (o_orderkey % 3) * 0.02)) WHEN 2 THEN upper(o_orderpriority) ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'Not answerable' ELSE 'no' END END AS pred FROM orders)"""


def samples(spark, sf_dir):
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    kind = F.when(m == 0, "Int").when(m == 1, "Float").when(m == 2, "Str").otherwise("None")
    gold = F.when(m == 0, (k % 50).cast("string")).when(m == 1, F.format_string("%.2f", "o_totalprice")).when(m == 2, F.col("o_orderpriority")).otherwise("Not answerable")
    pred = F.when(m == 0, (k % 49).cast("string")).when(m == 1, F.concat(F.format_string("%.2f", F.col("o_totalprice") * (1 + (k % 3) * F.lit(0.02))), F.lit("%"))).when(m == 2, F.upper("o_orderpriority")).otherwise(F.when(k % 3 == 0, "Not answerable").otherwise("no"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), gold.alias("answer"), pred.alias("pred"), F.col("o_orderstatus").alias("doc_type"), F.array_repeat(F.lit(1), (k % 3 + 1).cast("int")).alias("evidence_pages"), F.array(F.lit("Table"), F.col("o_orderpriority")).alias("evidence_sources"))
    return rows.withColumn("score", S.answer_score(F.col("answer"), F.col("pred"), F.col("kind")))


_SCORE = f"""{_SAMPLES}, sc AS (SELECT *, CASE kind WHEN 'Int' THEN (gold = pred)::INT::DOUBLE WHEN 'Float' THEN CASE WHEN abs(gold::DOUBLE - rtrim(pred, '%')::DOUBLE) <= 0.01 * greatest(gold::DOUBLE, rtrim(pred, '%')::DOUBLE) THEN 1.0 ELSE 0.0 END
  WHEN 'Str' THEN 1.0 ELSE CASE WHEN lower(gold) = lower(pred) THEN 1.0 ELSE 0.0 END END AS score FROM smp)"""


@FAMILY.add(f"WITH {_SCORE} SELECT o_orderkey, score FROM sc")
def score_answers(spark, sf_dir):
    """Scores of typed answers."""
    return samples(spark, sf_dir).select("o_orderkey", "score")


@FAMILY.add(
    f"""WITH {_SCORE}, a AS (SELECT kind, count(*) AS n, avg(score) AS accuracy, sum(score) FILTER (WHERE gold <> 'Not answerable') AS hit, count(*) FILTER (WHERE gold <> 'Not answerable') AS pos, count(*) FILTER (WHERE pred <> 'Not answerable') AS said FROM sc GROUP BY kind)
SELECT kind, n, round(accuracy, 6) AS accuracy, round(CASE WHEN pos = 0 OR said = 0 OR coalesce(hit, 0) = 0 THEN 0 ELSE 2 * (hit / pos) * (hit / said) / (hit / pos + hit / said) END, 6)::DOUBLE AS f1 FROM a"""
)
def score_f1(spark, sf_dir):
    """Accuracy and F1 by answer type."""
    return S.accuracy_and_f1(samples(spark, sf_dir), "kind").select("kind", "n", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@FAMILY.add(
    f"""WITH {_SCORE}, t AS (SELECT score, 'overall' AS section, 'all' AS name FROM sc UNION ALL SELECT score, 'pages', CASE WHEN gold = 'Not answerable' THEN 'unanswerable' WHEN o_orderkey % 3 = 0 THEN 'single' ELSE 'cross' END FROM sc
  UNION ALL SELECT score, 'type', o_orderstatus FROM sc JOIN orders USING (o_orderkey) UNION ALL SELECT score, 'source', 'Table' FROM sc UNION ALL SELECT score, 'source', o_orderpriority FROM sc JOIN orders USING (o_orderkey))
SELECT section, name, count(*) AS n, round(avg(score), 6) AS accuracy FROM t GROUP BY ALL"""
)
def score_report(spark, sf_dir):
    """Breakdown of scores by pages, source and type."""
    return S.report(samples(spark, sf_dir)).select("section", "name", "n", F.round("accuracy", 6).alias("accuracy"))


@FAMILY.add("SELECT quality AS gold, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL")
def score_confusion(spark, sf_dir):
    """Confusion of two label columns."""
    return S.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@FAMILY.add(
    """
WITH c AS (SELECT s_suppkey, s_name, CASE s_suppkey % 5 WHEN 0 THEN ' "' || s_name || '" ' WHEN 1 THEN '$12.50%' WHEN 2 THEN '3 miles (about)' WHEN 3 THEN '5 million' ELSE s_name || ' (x)' END AS a FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN lower(s_name) WHEN 1 THEN '12.50' WHEN 2 THEN '3 miles' WHEN 3 THEN '5' ELSE lower(s_name) END AS clean FROM c"""
)
def score_clean_answers(spark, sf_dir):
    """Cleaned answers."""
    m = F.col("s_suppkey") % 5
    a = F.when(m == 0, F.concat(F.lit(' "'), "s_name", F.lit('" '))).when(m == 1, "$12.50%").when(m == 2, "3 miles (about)").when(m == 3, "5 million").otherwise(F.concat("s_name", F.lit(" (x)")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.clean_answer(a).alias("clean"))
