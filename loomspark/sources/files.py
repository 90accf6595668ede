"""Reading and writing the files around the engine: JSON lines, page trees, caches, logs, result folders."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines of JSON with a fixed schema; a broken line fails the read; a missing path gives an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_jsonl_checked(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, broken lines as file, line_no and line). A line is broken if it isn't JSON of the schema; blank lines are neither.

    Files are split by whole lines and numbered by position within their file: a line's number is its place in its split plus the lines of the file's splits before it."""
    lines = _numbered_lines(spark, path)
    wide = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = lines.where(F.trim("line") != "").withColumn("_r", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    return parsed.where(~bad).select(*[F.col("_r")[f].alias(f) for f in schema.fieldNames()]), parsed.where(bad).select("file", "line_no", "line")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files, line numbers from 1. Only the counts of each file's splits are summed over a window."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    splits = read.groupBy("file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return read.join(before, ["file", "_start"]).select("file", (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_pages(spark: SparkSession, root: str, pattern: str = "*.md", excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of all files below root whose names match, each file one row; paths are relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").rsplit("://", 1)[-1] + "/"  # a file's path goes on after the folder's, whatever scheme stands in front
    rows = files.select(F.col("path").substr(F.locate(base, F.col("path")) + len(base), F.length("path")).alias("path"), F.decode(F.col("content"), "UTF-8").alias("text"))
    for prefix in excluded:
        rows = rows.where(~F.startswith("path", F.lit(prefix)))
    return rows


def encode_vector(values: list[float]) -> bytes:
    """Little-endian float32, as vectors are exchanged in base 64."""
    return struct.pack(f"<{len(values)}f", *values)


def decode_vectors(df: DataFrame, column: str) -> DataFrame:
    """df with a base-64 column of little-endian float32 decoded to array<float>; null and broken strings give null."""
    def floats(raw: Column) -> Column:
        hexed = F.hex(raw)
        count = F.floor(F.length(hexed) / 8).cast("int")
        word = lambda i: F.concat(*[F.substr(hexed, i * 8 + 1 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)])

        def value(i: Column) -> Column:
            bits = F.conv(word(i), 16, 10).cast("long")
            sign = F.when(bits.bitwiseAND(F.lit(1 << 31)) != 0, -1.0).otherwise(1.0)
            exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255))
            fraction = bits.bitwiseAND(F.lit((1 << 23) - 1)) / float(1 << 23)
            normal = sign * (1 + fraction) * F.pow(F.lit(2.0), exponent - 127)
            return F.when(exponent == 255, F.when(fraction == 0, sign * float("inf")).otherwise(F.lit(float("nan")))).when(exponent == 0, sign * fraction * 2.0**-126).otherwise(normal).cast("float")

        return F.when(F.length(hexed) == 0, F.array().cast("array<float>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), value))

    return df.withColumn(column, F.when(F.col(column).isNotNull(), floats(F.expr(f"try_to_binary({column}, 'base64')"))))


def append(df: DataFrame, path: str) -> None:
    """Rows added to an append-only cache or ledger."""
    df.write.mode("append").parquet(path)


def read_latest(spark: SparkSession, path: str, key: list[str], seq: str) -> DataFrame:
    """An append-only cache with the last write of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in rest])


def write_results(df: DataFrame, root: str, kind: str, split: str, run: str) -> None:
    """Result rows of a run, found again by their folders."""
    df.withColumns({"kind": F.lit(kind), "split": F.lit(split), "run": F.lit(run)}).write.mode("append").partitionBy("kind", "split", "run").parquet(root)


def list_results(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return spark.read.parquet(root).where(F.col("kind") == kind).groupBy("split", "run").agg(F.count("*").alias("rows")).orderBy("split", "run")


def write_report(lines: DataFrame, path: str) -> None:
    """Lines of a report, in order, as one text file; a report is as long as a page."""
    lines.orderBy("n").select("line").coalesce(1).write.mode("overwrite").text(path)


def create_tables(spark: SparkSession, root: str) -> None:
    """The three tables of an index, if they aren't there yet."""
    state = "ARRAY<STRUCT<feature_gate: STRING, state: STRING, since: STRING, default_enabled: BOOLEAN>>"
    spark.sql(f"CREATE TABLE IF NOT EXISTS contents_tbl (id BIGINT, key STRING, kind STRING, text STRING, embed_text STRING, n_tokens INT, versions ARRAY<STRING>, index_name STRING) USING parquet PARTITIONED BY (index_name) LOCATION '{root}/contents'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS occurrences_tbl (content_id BIGINT, chunk_id STRING, record_id STRING, url STRING, title STRING, heading_path ARRAY<STRING>, anchor STRING, feature_states {state}, content_type STRING, source_path STRING, commit STRING, version STRING) USING parquet PARTITIONED BY (version) LOCATION '{root}/occurrences'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS embeddings_tbl (content_id BIGINT, embedding ARRAY<FLOAT>, model STRING) USING parquet PARTITIONED BY (model) LOCATION '{root}/embeddings'")


LOCK = "version string, branch string, commit string, files map<string,int>"


def write_lock(sources: DataFrame, path: str) -> None:
    """The sources of a load (version, branch, commit, files by class), one JSON object each, in the order of their versions; a lock has as many rows as there are versions."""
    sources.select("version", "branch", "commit", "files").coalesce(1).sortWithinPartitions("version").write.mode("overwrite").json(path)


def read_lock(spark: SparkSession, path: str) -> DataFrame:
    """The locked sources; a missing lock is empty."""
    try:
        return spark.read.schema(LOCK).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LOCK)
        raise
