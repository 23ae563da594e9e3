"""Sources: heterogeneous files, JSON, CSV, pair folders and databases as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import extract, pages, text


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def files(spark: SparkSession, roots: Sequence[str], kinds: Sequence[str] = ("md", "txt", "json", "pdf"), most_pdf: int = 8 << 20) -> DataFrame:
    """path, kind, length and content of every file under the roots; PDFs up to a size; one row a
    path whatever its case, the first in order. Spark's scans pass over files of no bytes."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    rows = read.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).where(F.col("kind").isin(*kinds))
    rows = rows.where((F.col("kind") != "pdf") | (F.col("length") <= most_pdf))
    first = Window.partitionBy(F.lower("path")).orderBy("path")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("path", "kind", "length", "content")


#: Pages that are read to classify a file, to extract its record, and to match it.
SCAN_PAGES, RECORD_PAGES, MATCH_PAGES = 3, 6, 30


def bodies(found: DataFrame, most_pages: int | None = SCAN_PAGES) -> DataFrame:
    """``files`` with body and parse_status: texts decoded, JSON written anew or kept raw, the first pages of PDFs joined by
    line ends. A PDF without text, or that can't be read, has none and says so."""
    held = pages.page_texts(found.withColumn("__pdf", F.when(F.col("kind") == "pdf", F.col("content"))), "__pdf", most_pages)
    body = text.decoded(F.col("content"))
    parsed = F.try_parse_json(body)
    pdf = F.array_join("pages", "\n")
    rows = held.withColumn("body", F.when(F.col("kind") == "pdf", pdf).when(F.col("kind") == "json", F.coalesce(F.to_json(parsed), body)).otherwise(body))
    status = F.when((F.col("kind") == "json") & parsed.isNull(), "json_parse_error").when((F.col("kind") == "pdf") & (F.col("body") == ""), "pdf_text_empty").otherwise("ok")
    return rows.withColumn("parse_status", status).drop("content", "pages")


def whole_pdfs(found: DataFrame, least: int = 100) -> DataFrame:
    """PDFs of ``files`` with the text of all pages as body, null if it has at most ``least`` characters."""
    rows = pages.page_texts(found.where("kind = 'pdf'")).withColumn("body", F.array_join("pages", "\n"))
    return rows.withColumn("body", F.when(F.length("body") > least, F.col("body"))).drop("pages")


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object a line; blank lines go; no rows if the path is absent. Bad lines fail, or go."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A list of objects, or one, as rows."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns strings; a byte-order mark before the header goes."""
    read = spark.read.option("header", "true").option("multiLine", "true").option("quote", '"').option("escape", '"').csv(path)
    return read.toDF(*[c.lstrip("\ufeff") for c in read.columns])


def pairs(spark: SparkSession, root: str, names: Sequence[str] = ("report.md", "approval.md", "pair_metadata.json"), only: str = "*") -> DataFrame:
    """pair_id and one column a sibling file of each pair folder; null where it is missing. Only files of these names are
    listed, and only folders pair_``only``, a glob that file systems prune by."""
    at = root if only == "*" else f"{root}/pair_{only}"
    if not _exists(spark, at):
        return spark.createDataFrame([], "pair_id string, " + ", ".join(f"{n.rsplit('.', 1)[0]} string" for n in names))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(at)
    rows = read.select(F.regexp_extract("path", r"/(pair_[^/]+)/[^/]+$", 1).alias("pair_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), text.decoded(F.col("content")).alias("body"))
    rows = rows.where((F.col("pair_id") != "") & F.col("name").isin(*names))
    found = rows.groupBy("pair_id").pivot("name", list(names)).agg(F.first("body"))
    return found.select("pair_id", *[F.col(f"`{n}`").alias(n.rsplit(".", 1)[0]) for n in names])


def by_role(found: DataFrame, skip: Sequence[str] = ("/audit/", "/.git/")) -> DataFrame:
    """Files with a role: questions (JSON), theory or evidence (texts), by path; some paths skipped."""
    rows = found
    for part in skip:
        rows = rows.where(~F.contains("path", F.lit(part)))
    return rows.withColumn("role", F.when(F.col("kind").isin("json", "jsonl"), "qa").when(F.lower("path").rlike("wiki|theory|llm"), "theory").when(F.col("kind").isin("md", "txt"), "evidence"))


def preferred(found: DataFrame, folder: Column, is_preferred: Column) -> DataFrame:
    """The preferred file of each folder, then all files of folders without one."""
    rows = found.withColumn("folder", folder)
    first = rows.where(is_preferred)
    return first.unionByName(rows.join(first.select("folder").distinct(), "folder", "left_anti").select(*first.columns))


def first_by_priority(found: DataFrame, folder: Column, names: Sequence[str], preview: int = 2000) -> DataFrame:
    """One row a folder: its first file in the order of names, with the start of its body."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.regexp_extract("path", r"([^/]+)$", 1))
    rows = found.withColumn("folder", folder).withColumn("order", order).where("order > 0")
    first = Window.partitionBy("folder").orderBy("order", "path")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("folder", "path", F.substring("body", 1, preview).alias("preview"))


def packages(manifests: DataFrame, texts: DataFrame, comments: DataFrame, most: int = 20000) -> DataFrame:
    """Packages by folder: a manifest is needed, body and comments are optional."""
    n = comments.groupBy("folder").agg(F.count("*").alias("comment_count"))
    rows = manifests.join(texts.select("folder", F.substring("body", 1, most).alias("body")), "folder", "left").join(n, "folder", "left")
    return rows.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """PDF files by name: size in MB, year, company and document number guessed from the name, and whether it may be a
    decision. Other files are left out; contents aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    rows = read.withColumn("file_name", F.regexp_extract("path", r"([^/]+)$", 1)).where(F.lower("file_name").endswith(".pdf"))
    guessed = [g.alias(name) for name, g in extract.file_guesses(F.col("file_name")).items()]
    return rows.select("path", "file_name", F.round(F.col("length") / (1 << 20), 2).alias("size_mb"), *guessed)


def pair_flags(found: DataFrame, metadata: str = "pair_metadata") -> DataFrame:
    """What ``pairs`` found as one row a folder that has metadata: its fields, and whether each text is there."""
    field = lambda name: F.coalesce(F.get_json_object(F.col(metadata), f"$.{name}"), F.lit("")).alias(name)
    score = F.coalesce(F.get_json_object(F.col(metadata), "$.match_score").try_cast("double"), F.lit(0.0)).alias("match_score")
    there = [F.col(name).isNotNull().alias(f"has_{name}") for name in ("report", "approval")]
    return found.where(F.col(metadata).isNotNull()).select("pair_id", field("project_name"), field("company"), score, *there, field("approval_date"))


def database(spark: SparkSession, url: str, query: str, bounds: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query's rows. ``bounds`` (column, lower, upper, partitions) reads it over as many connections, each a range of the
    column; rows outside the bounds are in the first and the last."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if bounds is None:
        return reader.option("query", query).load()
    column, lower, upper, partitions = bounds
    return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions)).load()


def enabled(rows: DataFrame, value: str, label: str, flag: str = "is_enabled") -> DataFrame:
    """A dictionary's enabled entries with a value, as texts."""
    return rows.where((F.col(flag) == 1) & F.col(value).isNotNull() & (F.col(value).cast("string") != "")).select(F.col(value).cast("string").alias("value"), F.col(label).cast("string").alias("label"))


def undeleted(rows: DataFrame, flag: str = "is_delete") -> DataFrame:
    """Rows that are marked as not deleted."""
    return rows.where(F.col(flag) == 0)


def standards_index(spark: SparkSession, path: str) -> DataFrame:
    """code, qa_ref_count and kb_files from one JSON array inside a script constant."""
    body = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)(\[.*\])", 1).alias("body"))
    kind = "array<struct<code:string,qa_ref_count:int,kb_files:array<struct<file_name:string,path:string>>>>"
    return body.select(F.explode(F.from_json("body", kind)).alias("s")).select("s.*")
