"""Vector bin packing of examples into sequences, under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import trim
from .tokens import default_path, encoder

END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Fills sequences one at a time from a pool of pieces.

    A piece and the room left in a sequence are vectors of (tokens, 1 segment, loss-bearing tokens), as shares of the
    limits. The piece that fits with the largest dot product with the room goes in. When none fits, the piece with the
    largest product is cut so that it fills the room (with cut), or the sequence is closed. Each id lies in exactly one
    piece. The pool is bounded, so memory is too; what is left at the end of a partition makes its last sequences.
    """

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool = True, pool: int = 2048):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limits = np.array([max_tokens, max_segments, max_loss], np.float64)
        self.cut, self.most, self.items = cut, pool, []
        self.size = np.zeros((2 * pool, 3))
        self.made = 0

    def add(self, key: object, ids: np.ndarray, loss: np.ndarray) -> Iterator[list[tuple]]:
        """Takes one example; yields sequences that are full, each a list of (key, start, ids, doc_tokens, loss)."""
        t, _, most = (int(x) for x in self.limits)
        total, at, n = np.concatenate(([0], np.cumsum(loss))), 0, len(ids)
        if not self.cut and (n > t or total[-1] > most):
            raise ValueError(f"example {key} is over the limits and may not be cut")
        while self.cut and (n - at > t or total[-1] - total[at] > most):  # whole sequences' worth
            end = min(at + t, int(np.searchsorted(total, total[at] + most, "right")) - 1, n)
            if end - at == t:
                yield [(key, at, ids[at:end], n, int(total[end] - total[at]))]
            else:
                self._put(key, at, ids[at:end], n, loss[at:end])
            at = end
        self._put(key, at, ids[at:], n, loss[at:])
        while len(self.items) >= self.most:
            yield self._fill()

    def rest(self) -> Iterator[list[tuple]]:
        while self.items:
            yield self._fill()

    def _put(self, key: object, at: int, ids: np.ndarray, n: int, loss: np.ndarray) -> None:
        if len(ids):
            if len(self.items) == len(self.size):
                self.size = np.concatenate((self.size, np.zeros_like(self.size)))
            self.size[len(self.items)] = len(ids), 1, loss.sum()
            self.items.append((key, at, ids, n, loss))

    def _take(self, i: int) -> tuple:
        item, last = self.items[i], self.items.pop()
        if i < len(self.items):
            self.items[i], self.size[i] = last, self.size[len(self.items)]
        return item

    def _fill(self) -> list[tuple]:
        room, out = self.limits.copy(), []
        while self.items and room[0] >= 1 and room[1] >= 1:
            size = self.size[: len(self.items)]
            worth = (size / self.limits) @ (room / self.limits)
            fits = (size <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, worth, -1)))
                key, at, ids, n, loss = self._take(i)
            elif self.cut:
                i = int(np.argmax(worth))
                key, at, ids, n, loss = self.items[i]
                end = min(int(room[0]), int(np.searchsorted(np.cumsum(loss), room[2], "right")))
                if not end:
                    break
                self._take(i)
                self._put(key, at + end, ids[end:], n, loss[end:])
                ids, loss = ids[:end], loss[:end]
            else:
                break
            out.append((key, at, ids, n, int(loss.sum())))
            room -= len(ids), 1, loss.sum()
        return out


def pack(rows: DataFrame, key: str, parts: Column, path: str | None = None, max_tokens: int = 1024, max_segments: int = 256, max_loss: int = 1024, cut: bool = True, end_id: int = END) -> DataFrame:
    """Packs examples into sequences; columns PIECES, with doc_id the long of column key.

    parts: array of struct(text string, loss boolean); an example's ids are those of its parts one after another, then
    end_id, and the ids of parts with loss, and of the end after such a part, bear loss. Null parts and null texts are
    empty, so each row has at least the end id. Repeated rows are packed as often as they come; a null key stays null.
    Each partition packs its own rows: nothing is shuffled, and only its last sequences may be padded.
    """
    path = path or default_path()
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, ctx = encoder(path), Packer(max_tokens, max_segments, max_loss, cut), TaskContext.get()
        first = (ctx.partitionId() if ctx else 0) << 33
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

        def take(sequences: Iterator[list[tuple]]) -> None:
            for pieces in sequences:
                offset = 0
                for doc, at, ids, n, loss in pieces:
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + packer.made, offset, loss))
                    offset += len(ids)
                packer.made += 1

        for batch in batches:
            trim()
            for doc, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, loss, bears = [], [], False
                for part in row or ():
                    got, bears = enc.ids((part and part["text"]) or ""), bool(part and part["loss"])
                    ids.append(got)
                    loss.append(np.full(len(got), bears, np.int64))
                ids.append(np.array([end_id], np.uint32))
                loss.append(np.array([bears], np.int64))
                take(packer.add(doc, np.concatenate(ids), np.concatenate(loss)))
                if len(out) >= 20_000:
                    yield flush()
        take(packer.rest())
        if out:
            yield flush()

    return rows.select(F.col(key).cast("long").alias("key"), parts.alias("parts")).mapInArrow(run, PIECES)


def document_parts(text: str = "text") -> Column:
    return F.array(F.struct(F.col(text).alias("text"), F.lit(True).alias("loss")))


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = 1024, max_segments: int = 256) -> DataFrame:
    """Documents (doc_id, text) of which every id bears loss, so that the limit on these is that on tokens. A null text is
    empty and has its end id only; repeated rows are packed each; other columns are not read."""
    return pack(docs, "doc_id", document_parts(), path, max_tokens, max_segments, max_tokens)


def pack_conversations(turns: DataFrame, path: str | None = None, max_tokens: int = 1024, max_segments: int = 16, max_loss: int = 768, cut: bool = True) -> DataFrame:
    """Instruction data (conv_id, turn, role, text): a conversation is one example, and assistant turns bear loss.

    Turns come in order of (turn, role, text). A conversation is gathered as one row, so it must fit in memory.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").alias("key")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return pack(whole, "key", F.transform("turns", lambda t: F.struct(t["text"].alias("text"), (t["role"] == "assistant").alias("loss"))), path, max_tokens, max_segments, max_loss, cut)
