"""Removal of byte strings that also stand in an earlier document, by a bucketed suffix sort.

Every window of LENGTH bytes has a least K-byte substring, by a hash. Consecutive windows with the same one form a
stretch, and equal windows have equal least substrings wherever they stand, so stretches are dealt to buckets by it and
buckets are independent. In a bucket, least substrings of one document are put aside; equal stretches are merged, and all
but those of the least document are covered; the windows of what is left are suffix-sorted, and equal neighbours make the
classes whose least document keeps its bytes.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import _INVERSE, by_bytes, materialise, mix, powers, prefix_hashes, rows_of, span_hashes, text_bytes, texts
from .suffixsort import Suffixes

LENGTH, K = 50, 12
_LEVEL = 6
_BATCH, _BUCKET, _ROWS = 3 << 20, 12 << 20, 20_000


def _packed(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays, flat, in a few bytes more than they hold, so that very many small blobs cost little; compressed if that helps."""
    import zstandard

    head = b"".join(a.dtype.char.encode() + struct.pack("<I", a.size) for a in arrays)
    raw = bytes([len(arrays)]) + head + b"".join(a.tobytes() for a in arrays)
    return b"\0" + raw if len(raw) < 256 else b"\1" + zstandard.ZstdCompressor(level=level).compress(raw)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob[1:]) if blob[0] else blob[1:]
    out, at = [], 1 + 5 * raw[0]
    for i in range(raw[0]):
        kind, n = chr(raw[1 + 5 * i]), struct.unpack_from("<I", raw, 2 + 5 * i)[0]
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def _packed_rows(rows: list[tuple]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=_LEVEL).compress(pickle.dumps(rows, protocol=5))


def _unpacked_rows(blob: bytes) -> list[tuple]:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _cuts(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each of the sorted keys that is there, and where it stands."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False):
        yield int(keys[a]), slice(a, b)


def _home(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64) ^ mix(tie.astype(np.int64).view(np.uint64))) % np.uint64(n)).astype(np.int64)


def _substring_hashes(data: np.ndarray, k: int, block: int = 1 << 18) -> np.ndarray:
    """The hash of each k-byte substring; a hash doesn't depend on where prefixes start, so blocks are done one by one."""
    out = np.empty(len(data) - k + 1, np.uint64)
    for i in range(0, len(out), block):
        n = min(block, len(out) - i)
        prefix = prefix_hashes(data[i : i + n + k - 1])
        out[i : i + n] = mix((prefix[k:] - prefix[:-k]) * powers(_INVERSE, n))
    return out


def _least_of_rows(windows: np.ndarray, k: int) -> np.ndarray:
    """The upper half of the hash of the least k-byte substring of each row, some rows at once."""
    out = np.empty(len(windows), np.uint32)
    for i in range(0, len(windows), _ROWS):
        flat = np.append(windows[i : i + _ROWS].reshape(-1), np.zeros(k - 1, np.uint8))
        h = _substring_hashes(flat, k).reshape(-1, windows.shape[1])
        out[i : i + _ROWS] = h[:, : windows.shape[1] - k + 1].min(axis=1) >> np.uint64(32)
    return out


def _sorted_span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 20_000) -> np.ndarray:
    """span_hashes() of spans in order of their starts, some at once."""
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), block):
        s, e = start[i : i + block], end[i : i + block]
        out[i : i + block] = span_hashes(prefix_hashes(data[s[0] : e.max()]), s - s[0], e - s[0])
    return out


def stretches(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first byte of each stretch, its number of windows (length - k + 1 at most), and the hash of the least
    substring; starts are those of the texts in data, with its end last. No window crosses the end of a text."""
    wide, n = length - k + 1, len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, step = _substring_hashes(data, k), 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: -(wide - step)], least[wide - step :])
    fresh = np.ones(n, bool)
    fresh[1:] = least[1:] != least[:-1]
    whole = np.ones(n, bool)
    for s in starts[1:]:
        whole[max(0, s - length + 1) : s] = False
    fresh[starts[:-1][starts[:-1] < n]] = True
    fresh[1:] |= whole[1:] != whole[:-1]
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, n))
    at, count = at[whole[at]], count[whole[at]]
    parts = -(-count // wide)  # a long run of one substring, as in repeated characters, is cut
    if (parts > 1).any():
        first = np.repeat(at, parts) + wide * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.minimum(wide, np.repeat(at + count, parts) - first)
        at = first
    return at, count, least[at]


def _contexts(data: np.ndarray, at: np.ndarray, count: np.ndarray, length: int, width: int) -> np.ndarray:
    """The bytes of each stretch, filled up with zeros to width."""
    out = np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(width, np.uint8))), width)[at].copy()
    out[np.arange(width)[None, :] >= (count + (length - 1))[:, None]] = 0
    return out


def _merge(doc: np.ndarray, key: np.ndarray, ctx: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key then doc, and for each place in it the place of the first equal stretch (itself: none before)."""
    order = np.lexsort((doc, key))
    k, c = key[order], count[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if len(order) else order
    same = np.ones(len(order), bool)
    for i in range(0, len(order), _ROWS):
        same[i : i + _ROWS] = (ctx[order[i : i + _ROWS]] == ctx[order[lead[i : i + _ROWS]]]).all(axis=1)
    return order, np.where(same, lead, np.arange(len(order)))  # a collision stays by itself


def _dealt(docs: DataFrame, buckets: int, homes: int, length: int, k: int) -> DataFrame:
    """bucket, kind (context or span) and blob: stretches by bucket, each distinct one once a batch, and the spans that
    a smaller document of the same batch covers."""
    width = 2 * length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            group.sort(key=lambda r: (r[0], r[2]))
            ids, ties = (np.array([r[i] for r in group], np.int64) for i in (0, 2))
            starts = np.concatenate(([0], np.cumsum([len(r[1]) for r in group]))).astype(np.int64)
            data = np.frombuffer(b"".join(r[1] for r in group), np.uint8)
            at, count, least = stretches(data, starts, length, k)
            if not len(at):
                continue
            row = (np.searchsorted(starts, at, "right") - 1).astype(np.int32)
            ctx, whole = _contexts(data, at, count, length, width), _sorted_span_hashes(data, at, at + count + (length - 1))
            order, lead = _merge(ids[row], whole, ctx, count)
            base = order[lead]  # what each one in order equals
            covered = ids[row[order]] > ids[row[base]]
            twin = ~covered & (lead != np.arange(len(order)))  # of the same doc_id as its base
            done, keep = order[covered], np.sort(order[lead == np.arange(len(order))])
            where = at - starts[row]
            blobs: list[tuple[int, str, bytes]] = []
            bucket = (least[keep] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            place = np.zeros(len(at), np.int64)
            own = {b: keep[by[cut]] for b, cut in _cuts(bucket[by])}
            for one in own.values():
                place[one] = np.arange(len(one))
            of, same = base[twin], order[twin]
            home = (least[of] % np.uint64(buckets)).astype(np.int64)
            t_by = np.argsort(home, kind="stable")
            twins = {b: t_by[cut] for b, cut in _cuts(home[t_by])}
            for b, one in own.items():
                t = twins.get(b, t_by[:0])
                here = np.unique(np.concatenate((row[one], row[same[t]])))
                used = ctx[one][np.arange(width)[None, :] < (count[one] + (length - 1))[:, None]]
                steps = np.diff(np.searchsorted(here, row[one]), prepend=0).astype(np.int32), np.diff(where[one], prepend=0).astype(np.int32)
                blobs.append((b, "context", _packed(np.diff(ids[here], prepend=0), ties[here], *steps, count[one].astype(np.uint8), used, place[of[t]].astype(np.int32), np.searchsorted(here, row[same[t]]).astype(np.int32), where[same[t]].astype(np.int32), level=_LEVEL)))
            if len(done):
                h = _home(ids[row[done]], ties[row[done]], homes)
                sorted_ = np.lexsort((where[done], row[done], h))
                for b, cut in _cuts(h[sorted_]):
                    d = done[sorted_[cut]]
                    blobs.append((int(least[0] % np.uint64(buckets)), f"span {b}", _packed(ids[row[d]], ties[row[d]], where[d], where[d] + count[d] + (length - 1))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    return docs.select("doc_id", "text", "tie").mapInArrow(run, "bucket long, kind string, blob binary")


def _spans_of_bucket(blobs: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """doc, tie, start, end of the spans covered by a smaller document, for the contexts of one bucket."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]
    twins: list[list[np.ndarray]] = [[] for _ in range(3)]
    total = 0
    while blobs:  # each is dropped once it is unpacked
        ids, ties, row, step, count, used, of, row2, where2 = _unpacked(blobs.pop())
        ids, row, count = np.cumsum(ids), np.cumsum(row), count.astype(np.int64)
        ctx = np.zeros((len(row), 2 * length - k), np.uint8)
        ctx[np.arange(ctx.shape[1])[None, :] < (count + (length - 1))[:, None]] = used
        short = _least_of_rows(ctx[:, :length], k)
        for c, a in zip(cols, (ids[row], ties[row], np.cumsum(step, dtype=np.int64), count, short, ctx), strict=False):
            c.append(a)
        for c, a in zip(twins, (of.astype(np.int64) + total, ties[row2], where2.astype(np.int64)), strict=True):
            c.append(a)
        total += len(row)
    doc, tie, where, count, short = (np.concatenate(c) for c in cols[:5])
    ctx = np.concatenate(cols.pop(5))
    t_of, t_tie, t_where = (np.concatenate(c) for c in twins)
    none = np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # entry, first and one past the last byte, in the entry

    def many(order: np.ndarray, key: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of entries in order of key, those of keys with more than one document."""
        if not len(order):
            return order
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        mixed = np.minimum.reduceat(of[order], first) != np.maximum.reduceat(of[order], first)
        return order[np.repeat(mixed, np.diff(np.append(first, len(order))))]

    order = np.argsort(short, kind="stable")
    left = many(order, short[order], doc)
    if len(left):
        whole = np.empty(len(left), np.uint64)
        for i in range(0, len(left), _ROWS):
            e = left[i : i + _ROWS]
            sub = Suffixes(ctx[e], length)
            whole[i : i + _ROWS] = mix(sub.hashes(np.arange(len(e)), np.zeros(len(e), np.int64), count[e] + (length - 1)) + short[e])
        order, lead = _merge(doc[left], whole, ctx[left], count[left])
        covered = doc[left[order]] > doc[left[order[lead]]]
        e = left[order[covered]]
        out.append((e, np.zeros(len(e), np.int64), count[e] + (length - 1)))
        # what equals another entry of the same document shares its fate; it is kept, as it is rare here
        rest = left[np.sort(order[~covered])]
        rest = many(rest, short[rest], doc)
        cuts = np.flatnonzero(np.concatenate(([True], short[rest][1:] != short[rest][:-1], [True]))) if len(rest) else none
        at = 0
        while at + 1 < len(cuts):  # whole groups, some _ROWS entries at once
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + _ROWS)) - 1)
            out.append(_by_suffixes(rest[cuts[at] : cuts[to]], doc, count, short, ctx, length))
            at = to
    entry, a, b = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (none, none, none)
    d, t, s, e = doc[entry], tie[entry], where[entry] + a, where[entry] + b
    if len(t_of) and len(entry):  # twins of entries with spans
        by = np.argsort(entry, kind="stable")
        lo, hi = np.searchsorted(entry[by], t_of), np.searchsorted(entry[by], t_of, "right")
        n = hi - lo
        which = np.repeat(np.arange(len(t_of)), n)
        pick = by[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        d, t = np.concatenate((d, doc[entry[pick]])), np.concatenate((t, t_tie[which]))
        s, e = np.concatenate((s, t_where[which] + a[pick])), np.concatenate((e, t_where[which] + b[pick]))
    return d, t, s, e


def _by_suffixes(rest: np.ndarray, doc: np.ndarray, count: np.ndarray, short: np.ndarray, ctx: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entry, start and end in it of the stretches of windows that stand in a smaller document, by suffix sort."""
    sub, n = Suffixes(ctx[rest], length), count[rest]
    row = np.repeat(np.arange(len(rest)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = mix(sub.hashes(row, at, length) + short[rest][row])
    # suffixes whose hash no other document has are classes of their own
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    of = doc[rest[row[order]]]
    mixed = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    live = np.sort(order[np.repeat(mixed, np.diff(np.append(first, len(order))))])
    row, at = row[live], at[live]
    order, number = sub.classes(short[rest][row], row, at)
    if not len(order):
        return order, order, order
    row, at = row[order], at[order]
    of = doc[rest[row]]
    by = np.argsort(number, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], number[by][1:] != number[by][:-1])))
    least = np.zeros(len(of), of.dtype)
    least[by] = np.repeat(np.minimum.reduceat(of[by], first), np.diff(np.append(first, len(by))))
    hit = of > least
    row, at = row[hit], at[hit]
    by = np.lexsort((at, row))
    row, at = row[by], at[by]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    i = np.flatnonzero(fresh)
    j = np.append(i[1:], len(row)) - 1 if len(i) else i
    return rest[row[i]], at[i], at[j] + length


def duplicate_spans(docs: DataFrame, homes: int, buckets: int, length: int = LENGTH, k: int = K) -> DataFrame:
    """home and blob (doc_id, tie, start, end arrays): the bytes of docs (doc_id, text, tie) that a string of length
    bytes covers which also starts in a document of a smaller doc_id."""
    ship(docs.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(int(kind[5:]), blob) for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True) if kind != "context"]
        contexts = [blob for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True) if kind == "context"]
        del pdf
        if len(contexts):
            doc, tie, start, end = _spans_of_bucket(contexts, length, k)
            home = _home(doc, tie, homes)
            by = np.lexsort((start, doc, home))
            for h, cut in _cuts(home[by]):
                i = by[cut]
                out.append((h, _packed(doc[i], tie[i], start[i], end[i])))
        return pd.DataFrame(out, columns=["home", "blob"])

    return _dealt(docs, buckets, homes, length, k).groupBy("bucket").applyInPandas(run, "home long, blob binary")


def _texts_by_home(docs: DataFrame, homes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            home = _home(np.array([r[0] or 0 for r in group], np.int64), np.array([r[2] for r in group], np.int64), homes)
            by = np.argsort(home, kind="stable")
            rows = [(h, _packed_rows([group[i] for i in by[cut]])) for h, cut in _cuts(home[by])]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["home", "blob"])

    return docs.select("doc_id", "text", "tie").mapInArrow(run, "home long, blob binary")


def _rows(spans: pd.DataFrame, blobs: pd.DataFrame) -> Iterator[tuple[int | None, bytes, np.ndarray, np.ndarray]]:
    """doc_id, text, and the starts and ends of its maximal covered runs."""
    parts = [_unpacked(b) for b in spans["blob"]]
    doc, tie, start, end = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 4
    by = np.lexsort((start, tie, doc))
    doc, tie, start, end = doc[by], tie[by], start[by], end[by]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])
    first = np.flatnonzero(fresh)
    known = {(int(doc[i]), int(tie[i])): (i, j) for i, j in zip(first, np.append(first[1:], len(doc)), strict=True)}
    for blob in blobs["blob"]:
        for d, text, t in _unpacked_rows(blob):
            i, j = known.get((d, t), (0, 0))
            if i == j:
                yield d, text, start[:0], end[:0]
                continue
            s, e = start[i:j], np.maximum.accumulate(end[i:j])
            cut = np.flatnonzero(s[1:] > e[:-1])
            yield d, text, s[np.concatenate(([0], cut + 1))], e[np.concatenate((cut, [len(s) - 1]))]


def _kept(text: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))


def deduplicate(docs: DataFrame, length: int = LENGTH, k: int = K, with_bytes: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    and with_bytes also kept (binary: what is left).

    A byte is removed if a string of length bytes that covers it also starts in a document of a smaller doc_id; all is
    judged on the texts as they come in. Null texts are empty. Rows of one doc_id don't remove each other's bytes, and a
    row without doc_id neither removes nor loses any.
    """
    ship(docs.sparkSession)
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    size = text_bytes(rows)
    buckets = max(4, -(-size // _BUCKET))
    homes = max(4, -(-size // _BUCKET))
    spans = materialise(duplicate_spans(rows.where("doc_id is not null"), homes, buckets, length, k))
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, text, s, e in _rows(left, right):
            kept = _kept(text, s, e)
            out.append((d, len(text), len(text) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), *[kept] * with_bytes))
        df = pd.DataFrame(out, columns=[c.split()[0] for c in kind.split(", ")])
        return df.astype({"doc_id": "Int64"})

    return spans.groupBy("home").cogroup(_texts_by_home(rows, homes).groupBy("home")).applyInPandas(run, kind)
