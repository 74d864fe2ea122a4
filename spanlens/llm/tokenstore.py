"""Documents as token ids in binary shards, each document compressed by itself with one shared dictionary.

A shard: MAGIC; the frames of its documents in ascending order of doc_id; an index of little-endian 64-bit words (all
offsets, one more than documents, then all doc_ids, then all id counts, then one word of bits per 64 documents for null
doc_ids); a tail of TAIL bytes: documents, where the index starts, bytes an id, and the dictionary's SHA-256.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import filesystem, materialise, shared_dir, text_bytes, texts
from .tokens import default_path, encoder

MAGIC = b"IDSHARD1"
TAIL = struct.Struct("<QQQ32s")
END = 0
#: Shards whose starts are summed in one task.
_GROUP = 4096


class ShardWriter:
    def __init__(self, out, dictionary: bytes, width: int, level: int = 3):
        import zstandard

        self.out, self.hash, self.width = out, hashlib.sha256(dictionary).digest(), width
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        self.offsets, self.docs, self.counts, self.nulls = [len(MAGIC)], [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.zstd.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))

    def close(self) -> None:
        at, n = self.offsets[-1], len(self.docs)
        nulls = np.packbits(np.array(self.nulls + [False] * (-n % 64), bool), bitorder="little")
        for part in (np.array(self.offsets, "<i8"), np.array(self.docs, "<i8"), np.array(self.counts, "<i8"), nulls):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(n, at, self.width, self.hash))


class ShardReader:
    """Reads any document of a shard by its place or doc_id, without reading the others."""

    def __init__(self, file, dictionary: bytes):
        import zstandard

        self.file, size = file, file.size()
        file.seek(size - TAIL.size)
        n, at, self.width, digest = TAIL.unpack(file.read(TAIL.size))
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("this shard was compressed with another dictionary")
        file.seek(at)
        index = file.read(size - TAIL.size - at)
        words = np.frombuffer(index, "<i8", 3 * n + 1)
        self.offsets, self.docs, self.counts = words[: n + 1], words[n + 1 : 2 * n + 1], words[2 * n + 1 :]
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, offset=8 * (3 * n + 1)), bitorder="little")[:n].astype(bool)
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.docs)

    def ids(self, place: int) -> np.ndarray:
        a, b = int(self.offsets[place]), int(self.offsets[place + 1])
        self.file.seek(a)
        return np.frombuffer(self.zstd.decompress(self.file.read(b - a), max_output_size=int(self.counts[place]) * self.width + 1), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        at = int(np.searchsorted(self.docs[int(self.nulls.sum()) :], doc_id)) + int(self.nulls.sum())
        return self.ids(at) if at < len(self) and self.docs[at] == doc_id else None


def train_dictionary(docs: DataFrame, path: str, sample: int = 512, longest: int = 16384, size: int = 65536) -> bytes:
    """A dictionary from the ids of at most sample texts of at most longest bytes, chosen by a hash of doc_id.

    Only compression depends on it. With too few texts to train on it is empty, and frames are plain ones.
    """
    import zstandard

    n = docs.count()
    share = min(1.0, 3 * sample / max(n, 1))
    chosen = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30))
    rows = docs.where(chosen & (F.octet_length("text") <= longest)).select("text").limit(sample).collect()
    enc = encoder(path)
    width = 2 if enc.tokenizer.get_vocab_size() <= 65536 else 4
    parts = [np.append(enc.ids(r["text"]), END).astype(f"<u{width}").tobytes() for r in rows]
    if len(parts) < 16 or sum(map(len, parts)) < 4096:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, to: str, path: str | None = None, dictionary: bytes | None = None, shard_bytes: int = 32 << 20) -> DataFrame:
    """Writes documents (doc_id, text) to shards below the URI to; returns the shards, a row each:
    path, n_docs, n_tokens, n_bytes, and start, the ids of all shards before.

    Shards follow ascending doc_id, null first; rows of equal doc_id go by a hash of their text, and are all kept. Null
    texts are empty; each document ends with id 0. An empty table gives no shard. Each attempt of a task writes a file
    of its own, and only the files of attempts that Spark took are listed. Other columns are not read.
    """
    path, spark = path or default_path(), docs.sparkSession
    ship(spark)
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    dictionary = train_dictionary(rows, path) if dictionary is None else dictionary
    fs, root = filesystem(to)
    fs.create_dir(root)
    with fs.open_output_stream(f"{root}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as f:
        f.write(dictionary)
    shards = max(1, -(-text_bytes(rows) // shard_bytes))
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, total, first = encoder(path), None, 0, None
        width = 2 if enc.tokenizer.get_vocab_size() <= 65536 else 4
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    fs, root = filesystem(to)
                    name, first = f"{root}/{uuid.uuid4().hex}.ids", doc
                    out = fs.open_output_stream(name)
                    writer = ShardWriter(out, shared.value, width)
                ids = np.append(enc.ids(text), np.uint32(END))
                writer.add(doc, ids)
                total += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "first": pa.array([first], pa.int64()), "tie": [None], "n_docs": [len(writer.docs)], "n_tokens": [total], "n_bytes": [writer.offsets[-1]]}, pa.schema([("path", pa.string()), ("first", pa.int64()), ("tie", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    # the number of a row tells equal rows apart, so that any number of them can be dealt to several shards
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie", "row").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tie", "row")
    made = ranged.select("doc_id", "text", "tie").mapInArrow(run, "path string, first long, tie long, n_docs long, n_tokens long, n_bytes long").withColumn("part", F.spark_partition_id())
    listed = materialise(made, f"{to.rstrip('/')}/shards-{uuid.uuid4().hex}").withColumn("of", F.floor(F.col("part") / _GROUP))
    # starts: within groups of shards, and before each group
    groups = listed.groupBy("of").agg(F.sum("n_tokens").alias("n")).select("of", F.coalesce(F.sum("n").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("group_start"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = listed.withColumn("own", own).join(groups, "of")
    return materialise(out.select("path", "n_docs", "n_tokens", "n_bytes", (F.col("own") + F.col("group_start")).alias("start")), f"{to.rstrip('/')}/starts-{uuid.uuid4().hex}")


def read(shards: DataFrame, to: str, dictionary_hash: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files of write()."""
    ship(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, bytes] = {}
        for batch in batches:
            for r in batch.to_pylist():
                fs, root = filesystem(to)
                with fs.open_input_file(r["path"]) as f:
                    f.seek(f.size() - 32)
                    digest = f.read(32)
                    if digest not in held:
                        with fs.open_input_file(f"{root}/{digest.hex()}.dictionary") as d:
                            held[digest] = d.read()
                    shard = ShardReader(f, held[digest])
                    starts = r["start"] + np.concatenate(([0], np.cumsum(shard.counts)))[:-1]
                    crcs = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(len(shard))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs.astype(np.int64), mask=shard.nulls), pa.array(starts.astype(np.int64)), pa.array(shard.counts.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, shards.count())
    return shards.select("path", "start").repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, spark: SparkSession, path: str | None = None) -> DataFrame:
    to = shared_dir(spark)
    return read(write(docs, to, path), to)
