"""Dense retrieval: unit vectors, cosine, and an embedder that is injected."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot, normalize_rows


def embed(texts: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], prefix: str = "", batch: int = 64) -> DataFrame:
    """key and embedding (unit array of doubles) from embedder, called with batches of prefixed texts."""
    kind = texts.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                v = np.asarray(embedder([prefix + t for t in part["text"]]), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(v / np.where(norm == 0, 1, norm))})

    return texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, f"{key} {kind}, embedding array<double>")


def cache_key(model: str, prefix: str, ids: list[str], texts: list[str]) -> str:
    """A name for embeddings that changes with anything that they depend on."""
    h = hashlib.sha256()
    for part in (model, prefix, *ids, *texts):
        h.update(part.encode() + b"\0")
    return h.hexdigest()


def content_key(texts: DataFrame, key: str, text: str, model: str, prefix: str = "") -> str:
    """As cache_key(), from a table: sums of hashes of its rows, so that no text reaches the driver and order is nothing."""
    one = F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit(""))), 256)
    halves = [F.sum(F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"h{i}") for i in range(4)]
    row = texts.agg(F.count("*").alias("n"), *halves).first()
    return hashlib.sha256("\0".join([model, prefix, *map(str, row)]).encode()).hexdigest()


def cached_embeddings(texts: DataFrame, key: str, text: str, embedder: Callable[[list[str]], np.ndarray], model: str, folder: str, prefix: str = "", batch: int = 64) -> DataFrame:
    """embed(), kept as a table in folder under a name that changes with model, prefix, keys and texts; where it is there
    already, the embedder is not called. A table that was not written to its end is made again."""
    path = f"{folder.rstrip('/')}/{content_key(texts, key, text, model, prefix)}.parquet"
    spark = texts.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        embed(texts, key, text, embedder, prefix, batch).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class DenseIndex:
    """chunks: doc_id, embedding, and text_id for rankings inside a text."""

    def __init__(self, chunks: DataFrame | None):
        self.chunks = None if chunks is None else chunks.withColumn("unit", normalize_rows(F.col("embedding")))

    def score(self, queries: DataFrame, restricted: bool = False) -> DataFrame:
        """query_id, doc_id, score of queries (query_id, embedding, text_id if restricted) against every chunk, or those
        of the query's text: a full ranking is defined on all of them."""
        if self.chunks is None:
            raise RuntimeError("index chunks before scoring")
        q = queries.withColumn("q", normalize_rows(F.col("embedding")))
        docs = self.chunks.select("doc_id", "unit", *["text_id"] * restricted)
        pairs = q.select("query_id", "q", *["text_id"] * restricted).join(docs, "text_id") if restricted else q.select("query_id", "q").crossJoin(docs)
        return pairs.select("query_id", "doc_id", dot(F.col("q"), F.col("unit")).alias("score"))

    def rank(self, queries: DataFrame, k: int | None = None, restricted: bool = False) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
        out = self.score(queries, restricted).withColumn("rank", F.row_number().over(order))
        return out if k is None else out.where(F.col("rank") <= k)
