"""The retrieval domain read from tables of other shapes: documents as texts, benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, find_all
from ..storage import materialise, small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.coalesce("text", F.lit("")).alias("body"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"))


def containing(bodies: DataFrame, spans: DataFrame, body: str, span: str, keys: list[str]) -> DataFrame:
    """Pairs of spans and bodies that hold them, found by an inner word of the span: rows of spans × rows of bodies
    that share the span's rarest inner word, then a literal test. Spans without an inner word meet every body."""
    inner = F.regexp_extract_all(span, F.lit(WORD), F.lit(0))
    s = spans.withColumn("_w", F.array_distinct(F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 2, F.lit(0)))))
    asked = s.select(F.explode("_w").alias("_t")).distinct()
    asked = small(materialise(asked))
    # bodies are read for their words once; neither they nor these words are shuffled, unless words or pairs are many
    posts = materialise(bodies.select(keys[0], F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))).alias("_t")).join(asked, "_t"))
    df = posts.groupBy("_t").agg(F.count("*").alias("_n"))
    rare = s.select(keys[1], F.explode("_w").alias("_t")).join(df, "_t", "left")
    rarest = rare.groupBy(keys[1]).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_t")).alias("r")).select(keys[1], F.col("r._t").alias("_t"))
    pairs = posts.join(small(materialise(rarest)), "_t").select(*keys)
    bare = s.where(F.size("_w") == 0).select(keys[1])
    pairs = pairs.union(bodies.select(keys[0]).join(bare))
    pairs = small(materialise(pairs))
    return bodies.join(pairs, keys[0]).join(spans, keys[1]).where(F.contains(body, F.col(span)))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, text_id, start, end: the first document, by id, that holds an item word for word."""
    pairs = containing(texts(spark, sf_dir), questions(spark, sf_dir), "body", "question", ["text_id", "question_id"]).where(F.length("question") > 0)
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("question_id").orderBy("text_id"))).where("_r = 1")
    start = F.get(find_all(F.col("question"), F.col("body")), F.lit(0))
    return first.select("question_id", "question", "text_id", start.alias("start"), (start + F.length("question")).alias("end"))
