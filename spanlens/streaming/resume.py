"""Appending answers to a log as questions arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_new(questions: DataFrame, transform, log: str, checkpoint: str, keys: tuple[str, ...] = ("config_id", "question_id")) -> StreamingQuery:
    """A stream that runs transform on each batch of questions and appends its rows to the Parquet log, leaving out keys that the
    log holds already, so that a batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(list(keys))
        try:
            done = spark.read.parquet(log).select(*keys).distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = None
        if done is not None:
            fresh = fresh.join(done, list(keys), "left_anti")
        transform(fresh).write.mode("append").parquet(log)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_key(events: DataFrame, keys: list[str], ts: str, watermark: str | None = None) -> DataFrame:
    """The first row of each key: by time on a table; on a stream, the first to arrive within the watermark."""
    if events.isStreaming:
        return (events.withWatermark(ts, watermark) if watermark else events).dropDuplicatesWithinWatermark(keys) if watermark else events.dropDuplicates(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(ts, *[c for c in rest if c != ts])).alias("r")).select(*keys, "r.*")
