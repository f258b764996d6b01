"""The stateless and keyed steps on streams of notes, codes and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlow.functions import text


def chunk_stream(notes: DataFrame, length: int = 200, overlap: int = 40) -> DataFrame:
    """(note_id, chunk_no, chunk) of notes (note_id, text) as they come; stateless."""
    return notes.select("note_id", F.posexplode(text.chunks(F.col("text"), length, overlap)).alias("chunk_no", "chunk"))


def keep_first_stream(codes: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Codes once for each (subject_id, code) within the watermark of ``time``."""
    return codes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["subject_id", "code"])


def verdict_counts(events: DataFrame, time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Verdicts of each type by event-time window; windows close after ``delay``."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return e.groupBy(F.window(time, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
