"""Sources and sinks: driver tables, text documents with integrity checks, key/value and vector stores, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of a source manifest; nothing is inferred.
MANIFEST = "contract_version string, story_id string, stream_id string, source_language string, documents array<struct<document_id: string, `order`: int, path: string, expected_sha256: string, editorial_label: string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(story_id, stream_id, source_language, document_id, order, path, expected_sha256) of a JSON manifest."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select("story_id", "stream_id", "source_language", F.explode("documents").alias("d")).select("story_id", "stream_id", "source_language", "d.document_id", "d.order", "d.path", "d.expected_sha256")


def manifest_violations(documents: DataFrame) -> DataFrame:
    """(rule, key): repeated ids and orders, ids that break the pattern, paths that are not relative and plain."""
    def repeated(column: str) -> DataFrame:
        return documents.groupBy("story_id", column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"repeated_{column}").alias("rule"), F.col(column).cast("string").alias("key"))

    bad_id = documents.where(~F.col("document_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$")).select(F.lit("bad_id").alias("rule"), F.col("document_id").alias("key"))
    bad_path = documents.where(F.col("path").rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)") | (F.col("path") == "")).select(F.lit("bad_path").alias("rule"), F.col("path").alias("key"))
    return repeated("document_id").unionByName(repeated("order")).unionByName(bad_id).unionByName(bad_path)


def read_documents(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(document_id, order, version, text, problem): strict UTF-8 texts whose SHA-256 is checked; problem is null where all is well."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    joined = manifest.join(files, F.element_at(F.split("path", "/"), -1) == F.col("name"), "left")
    version = F.sha2("content", 256)
    problem = F.when(F.col("content").isNull(), "MISSING").when(F.col("expected_sha256").isNotNull() & (version != F.col("expected_sha256")), "HASH_MISMATCH").when(~F.expr("is_valid_utf8(cast(content as string))"), "INVALID_UTF8")
    return joined.select("document_id", "order", version.alias("version"), F.when(problem.isNull(), F.decode("content", "utf-8")).alias("text"), problem.alias("problem"))


def chapters_in_range(documents: DataFrame, low: int, high: int) -> DataFrame:
    """Documents of chapters low to high; a missing chapter is an error. documents: order, ..."""
    spark = documents.sparkSession
    wanted = spark.range(low, high + 1).withColumnRenamed("id", "wanted")
    missing = wanted.join(documents.select("order"), F.col("wanted") == F.col("order"), "left_anti").orderBy("wanted").limit(5).collect()
    if missing:
        raise ValueError(f"missing chapters: {[r['wanted'] for r in missing]}")
    return documents.where(F.col("order").between(low, high))


def put_briefs(briefs: DataFrame, path: str) -> None:
    """Store (story, chapter, version, fingerprint, payload): a chapter's entry replaces the one before."""
    briefs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("story", "chapter").parquet(path)


def get_briefs(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Stored payloads whose story, chapter, version and fingerprint are all as wanted."""
    return spark.read.parquet(path).join(wanted, ["story", "chapter", "version", "fingerprint"], "left_semi")


def write_checked_json(df: DataFrame, path: str) -> None:
    """Store rows as (payload, payload_sha256)."""
    payload = F.to_json(F.struct(*df.columns))
    df.select(payload.alias("payload"), F.sha2(payload, 256).alias("payload_sha256")).write.json(path)


def read_checked_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a checked store; a payload that does not match its digest is an error."""
    raw = spark.read.schema("payload string, payload_sha256 string").json(path)
    sound = F.when(F.sha2("payload", 256) == F.col("payload_sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")))
    return raw.select(F.from_json(sound, schema).alias("r")).select("r.*")


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts (by digest) that a vector cache does not hold. texts: text; cache: text_sha256, vector."""
    return texts.select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"]).join(cache, "text_sha256", "left_anti")


def result_documents(hits: DataFrame) -> DataFrame:
    """(query, document): a query's hits in order as one JSON document. hits: query, id, rank, score."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "score")))
    return hits.groupBy("query").agg(F.to_json(F.struct(F.col("query"), ordered.alias("hits"))).alias("document"))
