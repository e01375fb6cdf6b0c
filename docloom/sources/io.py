"""Readers and writers of document collections. All of them go through Spark's own file access."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = (
    "type string, text string, text_level int, page_idx int, bbox array<double>, img_path string, image_caption array<string>, "
    "image_footnote array<string>, table_caption array<string>, table_footnote array<string>, table_body string, list_items array<string>, sub_type string, text_format string"
)
ITEM_FIELDS = [field.split()[0] for field in ITEM.split(", ")]
EDGE = "src string, dst string, type string, label string, unit string, span_role string"
SPARSE = "id string, role string, title string, caption string, table_schema string, labels string, aliases string, body string"
DENSE = "node_id string, variant string, role string, dense_text string"
# File names of a document's stages, best first.
PREFERENCE = ("enhanced.json", "adapted.v2.json", "adapted.json", "content_list.json")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON: objects, or arrays of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones dropped or, if strict, an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_view(df: DataFrame, path: str, *, by: str | None = None, mode: str = "overwrite") -> None:
    """A view as Parquet, one folder a value of ``by`` if given."""
    writer = df.write.mode(mode)
    (writer.partitionBy(by) if by else writer).parquet(path)


def _table_name(path: str) -> str:
    return "docloom_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int) -> None:
    """Parquet in ``buckets`` files by a hash of ``by``, each in its order; :func:`read_bucketed` knows them again."""
    dealt = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
    dealt.mode("overwrite").option("path", path).saveAsTable(_table_name(path))


def read_bucketed(spark: SparkSession, path: str, by: str, buckets: int) -> DataFrame:
    """A table of :func:`write_bucketed` with its buckets: filters on ``by`` read one, joins on it need no exchange.

    The session's catalog gets a definition that points to the files; dropping it leaves them.
    """
    name = _table_name(path)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def doc_id_of(column: Column | None = None) -> Column:
    """A document's id: its own, else the name of its file's folder, else ``document``."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    named = F.when(folder != "", folder)
    return F.coalesce(named, F.lit("document")) if column is None else F.coalesce(F.nullif(column, F.lit("")), named, F.lit("document"))


def read_content_lists(spark: SparkSession, path: str, *, pattern: str = "*content_list.json") -> DataFrame:
    """Parser items of all documents below a folder: ``doc_id, ord`` and the item's fields.

    One job reads every file; a file that cannot be parsed is left out.
    """
    rows = spark.read.schema(ITEM).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "DROPMALFORMED").json(path)
    numbered = rows.select(doc_id_of().alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), *ITEM_FIELDS)
    return numbered.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("file", "n")) - 1).drop("file", "n")


def list_files(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """``path, folder, name, size`` of all files below a folder, contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("size"))


def preferred_inputs(files: DataFrame) -> DataFrame:
    """The best stage file of each folder, by PREFERENCE; names may have a document's prefix."""
    rank = F.coalesce(*(F.when(F.col("name").endswith(name), F.lit(i)) for i, name in enumerate(PREFERENCE)))
    best = F.row_number().over(Window.partitionBy("folder").orderBy("rank", "name"))
    return files.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("r", best).where("r = 1").drop("r", "rank")


def page_images(files: DataFrame, *, zero_based: bool = False) -> DataFrame:
    """Images with the page number in their name: ``path, page_idx``."""
    number = F.regexp_extract("name", r"(\d+)\D*$", 1)
    return files.where(number != "").select("path", (number.cast("int") - (0 if zero_based else 1)).alias("page_idx"))


def missing_pages(wanted: DataFrame, images: DataFrame) -> DataFrame:
    """Wanted pages without an image: input of a rendering slot."""
    return wanted.join(images.select("page_idx").distinct(), "page_idx", "left_anti")


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """Dense view rows with variant (or role, or ``default``) and base id."""
    return read_jsonl(spark, path, DENSE).withColumn("variant", F.coalesce("variant", "role", F.lit("default"))).withColumn("base_id", F.substring_index("node_id", "#", 1))


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """Sparse documents, blank fields null, empty ones left out."""
    from docloom.operators.views import prune_sparse

    fields = ["title", "caption", "table_schema", "labels", "aliases", "body"]
    return prune_sparse(read_jsonl(spark, path, SPARSE).withColumnRenamed("id", "node_id"), fields)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, EDGE)


def page_items(pages: DataFrame) -> DataFrame:
    """Raw web pages (page_id, html) as items: ``h1``-``h6`` headings, ``p`` and ``li`` texts, in order.

    Navigation and footers are dropped. Scripts and comments do not count.
    """
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", " ")
    parts = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:h[1-6]|p|li)\b[^>]*>.*?)(?=<(?:h[1-6]|p|li|/article|/body|/html)\b|$)"), F.lit(1))
    rows = pages.select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(parts).alias("ord", "part"))
    tag = F.lower(F.regexp_extract("part", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("part", r"<[^>]+>", " "), r"\s+", " "))
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select("doc_id", "ord", F.lit("text").alias("type"), text.alias("text"), level.alias("text_level"), F.lit(0).alias("page_idx")).where("text <> ''")


def normalise_elements(elements: DataFrame) -> DataFrame:
    """Elements of other parsers in one shape: image to figure, text to paragraph, page from its aliases."""
    kind = F.when(F.col("type") == "image", "figure").when(F.col("type") == "text", "paragraph").otherwise(F.col("type"))
    names = [c for c in ("page", "page_idx", "page_no") if c in elements.columns]
    return elements.withColumn("type", kind).withColumn("page", F.coalesce(*names, F.lit(0)))


#: Layout names of a document up to which all are compared with each of its content names.
FEW_NAMES = 64


def enrich_with_layout(content: DataFrame, layout: DataFrame) -> DataFrame:
    """Content rows (img_path) with the layout box of the same file name, else of a name that contains its stem.

    Names are those of a document where both tables have ``doc_id``; the first name in order counts. Documents of at
    most ``FEW_NAMES`` names have them compared outright. Else names that contain another are found by an index of their
    short pieces: a stem asks for the rarest of its own, and only names that have it are compared.
    """
    base = lambda c: F.substring_index(c, "/", -1)
    stem = lambda c: F.regexp_replace(c, r"\.[^.]+$", "")
    own = ["doc_id"] if "doc_id" in content.columns and "doc_id" in layout.columns else []
    named = layout.select(*own, base(F.col("img_path")).alias("file"), "img_path", "bbox").where("file IS NOT NULL")
    boxes = named.groupBy(*own, "file").agg(F.min_by("bbox", "img_path").alias("exact_box"))
    rows = content.withColumn("file", base(F.col("img_path"))).join(boxes, [*own, "file"], "left")
    loose = rows.where("exact_box IS NULL").select(*own, "file", stem(F.col("file")).alias("stem")).where("stem <> ''").distinct()
    others = named.select(*own, stem(F.col("file")).alias("other"), "bbox").groupBy(*own, "other").agg(F.min_by("bbox", "other").alias("near_box"))
    small = []
    if own:
        counts = others.groupBy(*own).agg(F.count("*").alias("__n"))
        counted = others.join(counts, own)
        few, others = counted.where(F.col("__n") <= FEW_NAMES).drop("__n"), counted.where(F.col("__n") > FEW_NAMES).drop("__n")
        small = [loose.join(few, own).where(F.contains("other", F.col("stem"))).select(*own, "file", "other", "near_box")]
        loose = loose.join(counts.where(F.col("__n") > FEW_NAMES), own, "left_semi")
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1)), lambda i: F.substring(c, i, n)))
    index = others.select(*own, "other", F.explode(F.flatten(F.array(*(pieces(F.col("other"), F.lit(n)) for n in (1, 2, 3))))).alias("piece")).distinct()
    often = index.groupBy(*own, "piece").agg(F.count("*").alias("n"))
    asked = loose.select(*own, "file", "stem", F.explode(pieces(F.col("stem"), F.least(F.lit(3), F.length("stem")))).alias("piece"))
    rarest = asked.join(often, [*own, "piece"], "left").groupBy(*own, "file", "stem").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"))
    found = rarest.join(index, [*own, "piece"]).where(F.contains("other", F.col("stem"))).join(others, [*own, "other"]).select(*own, "file", "other", "near_box")
    found = reduce(DataFrame.unionByName, small, found)
    near = found.groupBy(*own, "file").agg(F.min_by("near_box", "other").alias("near_box"))
    return rows.join(near, [*own, "file"], "left").withColumn("bbox", F.coalesce("exact_box", "near_box")).drop("file", "exact_box", "near_box")


#: Columns of question samples: what is asked, the gold answer, and what a run adds.
SAMPLES = "doc_id string, question string, answer string, answer_format string, doc_type string, evidence_pages array<int>, evidence_sources array<string>, retrieved_pages array<int>, retrieved_scores array<double>, pred string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Question samples (JSON lines), with ``sample_id`` from their document and question."""
    rows = read_jsonl(spark, path, SAMPLES)
    return rows.withColumn("sample_id", F.substring(F.sha2(F.concat_ws("\n", "doc_id", "question"), 256), 1, 16))


def write_samples(samples: DataFrame, hits: DataFrame, path: str, *, k: int = 10) -> None:
    """Samples with the pages found for them (sample_id, page_idx, score), best first, at most ``k``, as JSON lines."""
    found = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct(F.col("score"), (-F.col("page_idx")).alias("p"))))), 1, k)
    listed = hits.groupBy("sample_id").agg(found.alias("h"))
    rows = samples.drop("retrieved_pages", "retrieved_scores").join(listed, "sample_id", "left")
    pages, scores = F.transform("h", lambda x: -x["p"]), F.transform("h", lambda x: x["score"])
    rows.withColumns({"retrieved_pages": pages, "retrieved_scores": scores}).drop("h").write.mode("overwrite").json(path)
