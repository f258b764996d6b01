"""Sources and sinks: every format has an explicit schema, and files are only read and written by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "subject_id long, note_id string, note_type string, charttime timestamp, age_at_note int, text string, DaysToLastNotes int, label byte"
CODES = "subject_id long, icd_code string, icd_version int, icd_code_ver string, age_at_code int, DaysToLastNotes int, long_title string"
RECORDS = "subject_id long, patient_text string, num_notes int, num_codes int, approx_tokens int, label double, full_context_approx_tokens int, k_per_query int"
PREDICTIONS = (
    "subject_id long, label int, num_input_tokens int, truncated boolean, notes_kept string, notes_total int, raw_completion string, parsed_probability double, parsed_report string, "
    "parse_ok boolean, generated_token string, logp_yes double, logp_no double, verbalizer_style string, rollout_idx int, temperature double, model string"
)
SCORES = "subject_id long, label int, probability double"
ROLLOUTS = "patients map<string, struct<candidates: array<struct<idx: int, sample_score: double, sample_score_calibrated: double, n_flagged: int, n_steps: int, n_content_steps: int>>, n_candidates_valid: int, n_candidates_scored: int, error: string>>"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, quoted newlines and doubled quotes; ``columns`` prunes at the scan."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; ``tolerant`` leaves out blank and malformed lines, else they fail."""
    return spark.read.json(path, schema=schema, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions with ``notes_kept`` (a number or a list of ids) in two columns."""
    df = read_jsonl(spark, path, PREDICTIONS)
    ids = F.from_json("notes_kept", "array<string>")
    return df.withColumn("notes_kept_n", F.coalesce(F.col("notes_kept").try_cast("int"), F.size(ids))).withColumn("notes_kept_ids", ids).drop("notes_kept")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents (an array of records, or one keyed map)."""
    return spark.read.json(path, schema=schema, multiLine=True)


def read_rollouts(spark: SparkSession, path: str) -> DataFrame:
    """(subject_id, place, idx, ...) of every candidate of a keyed rollout document."""
    flat = read_document(spark, path, ROLLOUTS).select(F.explode("patients").alias("sid", "v"))
    return flat.select(F.col("sid").cast("long").alias("subject_id"), F.posexplode("v.candidates").alias("place", "c")).select("subject_id", "place", "c.*")


def read_batches(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All files of a glob with ``file``, the name they came from, in the order of names."""
    return spark.read.json(pattern, schema=schema, multiLine=True).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def read_cache(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """A cache of JSON lines: malformed lines and lines without ``key`` are left out, and of several lines of one key the last one
    wins (by file name, then by place in the file)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    rows = lines.select(F.from_json("value", schema).alias("r"), F.struct("_file", "_at").alias("_order")).where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.max_by("r", "_order").alias("r")).select("r.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of ``candidates`` that ``df`` has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")


def write_vectors(df: DataFrame, path: str, dim: int) -> None:
    """A vector table (Parquet, snappy); a vector of another width fails the write."""
    checked = df.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of width "), F.size("vector").cast("string")))))
    checked.write.mode("overwrite").option("compression", "snappy").parquet(path)


def copied(spark: SparkSession, source: str, path: str) -> dict[str, int]:
    """A vector table copied as snappy Parquet; rows and bytes of both are reported."""
    df = spark.read.parquet(source)
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return {"rows": spark.read.parquet(path).count(), "bytes_before": stored_bytes(spark, source), "bytes_after": stored_bytes(spark, path)}


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()


WEIGHTS = "name string, shape array<int>, weights array<double>"


def write_weights(spark: SparkSession, path: str, weights: dict[str, np.ndarray], history: list[dict] | None = None) -> None:
    """Model weights as a table of named arrays, and the history of a run (one record for each epoch) as JSON lines beside it."""
    rows = [(name, list(w.shape), w.astype(float).ravel().tolist()) for name, w in weights.items()]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(path)
    if history:
        write_jsonl(spark.createDataFrame(history), f"{path}-history")


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.array(r["weights"]).reshape(r["shape"]) for r in spark.read.schema(WEIGHTS).parquet(path).collect()}


def write_document(df: DataFrame, path: str, key: str | None = None) -> None:
    """One JSON document in one text file: an array of records, or a map by ``key``, in the order of the key (else of the records).
    For results that a person reads: they are gathered in one task."""
    record = F.to_json(F.struct(*[c for c in df.columns if c != key]), {"ignoreNullFields": "false"})
    part = F.struct(*([F.col(key).cast("string").alias("k")] if key else []), record.alias("v"))
    all_ = df.agg(F.array_sort(F.collect_list(part)).alias("x"))
    item = (lambda e: F.concat(F.to_json(F.array(e["k"])).substr(F.lit(2), F.length(F.to_json(F.array(e["k"]))) - 2), F.lit(":"), e["v"])) if key else (lambda e: e["v"])
    body = F.concat(F.lit("{" if key else "["), F.array_join(F.transform("x", item), ","), F.lit("}" if key else "]"))
    all_.select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, append: bool = False) -> None:
    """JSON lines, one folder for each value of ``by`` (split, rank, batch)."""
    w = df.write.mode("append" if append else "overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_texts(df: DataFrame, path: str, name: str, text: str, manifest: bool = False) -> None:
    """One folder of a text file for each ``name``; what was there goes first.  With ``manifest`` a JSON document at
    ``<path>-manifest`` lists the names, their characters and digests."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)
    if manifest:
        write_document(df.select(F.col(name).alias("name"), F.length(text).alias("n_chars"), F.md5(F.col(text).cast("binary")).alias("md5")), f"{path}-manifest", key="name")


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; refuses more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
