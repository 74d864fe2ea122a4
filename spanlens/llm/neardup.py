"""Near-duplicate documents by circulant MinHash, banding, and verification on the words of full sets of shingles.

Documents with equal words form a class, represented by its least doc_id, so copies are never compared. Representatives
that share a band's key are candidates. First each is compared with the pivot of its band, the member that meets most
others in all its bands: this links most groups with one comparison a member. Then only bands whose members are still in
different components are looked at again: their members meet in blocks, and every pair of different components in
them is decided. A link of the least similarity shares no band with probability (1 - s**rows)**bands, 1e-7 for the
parameters here; every reported link is verified on words. With exact, candidates share a rare shingle instead (the prefix
that a link can't avoid), which misses no link, at a higher cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import by_bytes, discard, materialise, mix, rows_of, small, texts
from .components import components
from .shingles import Numbered, band_keys, circulant, copy_digest, linked, shingle_sets, words_of

ROWS, BANDS, PERCENT = 5, 40, 80
_BATCH = 1 << 20
#: Members of a band that meet in one task, and members that are compared with one copy of their pivot.
_BLOCK, _STAR = 1024, 256
#: Shingles of the members of a block, about.
_BLOCK_SHINGLES = 1 << 19
_NUMBERED = 200_000


def _set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, which don't depend on the order."""
    a, b = mix(shingles + np.uint64(11)), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(b).view(np.int64)) if len(b) else 0


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, copy (a digest of the words), two hashes of the set, band keys and the signature, for each row
    of docs. A null text is empty, and has no shingles."""
    ship(docs.sparkSession)
    kind = "doc_id long, n_shingles long, copy binary, c1 long, c2 long, bands array<long>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = circulant(rows * bands)

        def out(group: list[tuple]) -> pa.RecordBatch:
            words = [words_of(t) for _, t in group]
            copies = [copy_digest(w) for w in words]
            sets = shingle_sets(words)
            del words
            sigs = [minhash.signature(s) for s in sets]
            hashes = [_set_hashes(s) for s in sets]
            keys = np.concatenate([band_keys(s, rows) for s in sigs])
            arrays = [
                pa.array([d for d, _ in group], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(copies, pa.binary()), pa.array([a for a, _ in hashes], pa.int64()), pa.array([b for _, b in hashes], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * bands), pa.array(keys)), pa.array([s.tobytes() for s in sigs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "copy", "c1", "c2", "bands", "sig"])

        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            yield out(group)

    return texts(docs).mapInArrow(run, kind)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), of doc_ids, that are links: a written table.

    A document u with many partners is sent once for every _STAR of them, not with each; partners come one after another,
    sorted behind it, so no task holds more than one u and one v. Sets are compared as words. Of several
    texts of one doc_id any may link.
    """
    pairs = materialise(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    asked = small(materialise(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()))
    held = materialise(texts(docs).join(asked, "doc_id", "left_semi"))
    many = small(materialise(pairs.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > _STAR)))
    block = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / _STAR))).cast("int")
    dealt = materialise(pairs.join(many, "u", "left").select("u", "v", block.alias("block")))
    heads = dealt.select("u", "block").distinct().join(held, F.col("u") == F.col("doc_id")).select("u", "block", F.lit(0).alias("role"), F.col("doc_id").alias("v"), "text")
    tails = dealt.join(held, F.col("v") == F.col("doc_id")).select("u", "block", F.lit(1).alias("role"), "v", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, sets, numbered = None, [], None, Numbered()
        good: list[tuple[int, int]] = []
        for u, block, role, v, text in rows_of(batches, 4):
            if (u, block) != now:
                now, heads, sets = (u, block), [], None
            if role == 0:
                heads.append(words_of(text))
                continue
            if len(numbered) > _NUMBERED:
                numbered, sets = Numbered(), None
            if sets is None:
                sets = [numbered.set_of(w) for w in heads]
            own = numbered.set_of(words_of(text))
            if any(linked(s, own, percent) for s in sets):
                good.append((u, v))
            if len(good) >= 10_000:
                yield _pairs(good)
                good = []
        del heads, sets, numbered
        yield _pairs(good)

    met = heads.union(tails).repartition("u", "block").sortWithinPartitions("u", "block", "role")
    out = materialise(met.mapInArrow(run, "u long, v long").distinct())
    discard(pairs, asked, held, many, dealt)
    return out


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and set (sorted 64-bit hashes) of the documents that ids names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            sets = shingle_sets([words_of(t) for _, t in group])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["doc_id", "set"])

    return texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, set binary")


def _across(members: DataFrame, percent: int, coordinates: int | None) -> DataFrame:
    """u and v of members of one key with different labels whose hashed sets are linked, as many as tie their labels
    together; members: key, blocks, doc_id, label, n_shingles, bands, sig, set.

    Blocks of a key meet in pairs, so no task holds more than two. A pair is left out if its sizes exclude a link, or if
    signatures of so many coordinates agree in fewer than five and a bit deviations below percent would; the sets of
    other pairs are compared, each pair in the first band that it shares.
    """
    k = F.col("blocks")
    own = (F.pmod(F.xxhash64("doc_id"), k)).cast("int")
    split = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (k - 1).cast("int"))))
    split = split.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label", "n_shingles", "sig", "set", "bands")
    p = percent / 100
    least = 0 if coordinates is None else int(coordinates * (p - 5.2 * sqrt(p * (1 - p) / coordinates)))

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        rows.sort(key=lambda r: (r[6], r[4]))
        key, i, j = rows[0][:3]
        own, doc, label, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
        sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint32).reshape(len(rows), -1)
        sets = [np.frombuffer(r[8], np.uint64) for r in rows]
        keys = np.array([r[9] for r in rows], np.int64) if coordinates is not None else None
        first = np.argmax(keys == key, axis=1) if coordinates is not None else None
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        last = np.searchsorted(n, n * 100 // percent, "right")  # sizes ascend: larger ones can't be links
        for a in range(len(rows)):
            b = np.arange(a + 1, last[a])
            b = b[(label[b] != label[a]) & (doc[b] != doc[a]) & ((own[b] != own[a]) | (i == j))]
            if len(b):
                b = b[(sig[b] == sig[a]).sum(axis=1) >= least]
            if len(b) and keys is not None:
                b = b[np.argmax(keys[b] == keys[a], axis=1) == first[a]]
            for x in b.tolist():
                u, v = find(int(label[a])), find(int(label[x]))
                if u != v and linked(sets[a], sets[x], percent):
                    root[u] = v
                    out.append((int(doc[a]), int(doc[x])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for row in rows_of(batches, -1):
            if group and row[:3] != group[0][:3]:
                yield _pairs(compare(group))
                group = []
            group.append(row)
        if group:
            yield _pairs(compare(group))

    return split.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long")


def prefix_keys(docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles and key: of each representative's n shingles the n - ceil(percent n / 100) + 1 that fewest have. Two sets
    that are linked share one of these, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            for (d, _), s in zip(group, shingle_sets([words_of(t) for _, t in group]), strict=True):
                for i in range(0, len(s), 50_000):
                    part = s[i : i + 50_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), d, np.int64)), pa.array(part)], names=["doc_id", "key"])

    ids = small(materialise(reps.select("doc_id").distinct()))
    long = materialise(texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, key long").distinct())
    counts = long.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    by = long.join(counts, "key", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("s"))
    kept = F.size("s") - F.ceil(F.size("s") * percent / 100).cast("int") + 1
    out = materialise(by.select("doc_id", F.size("s").cast("long").alias("n_shingles"), F.explode(F.slice("s", F.lit(1), kept)).alias("k")).where("k.n > 1").select("doc_id", "n_shingles", "k.key"))
    discard(ids, long)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, exact: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_shingles, class_id (least doc_id of equal set), component_id
    (least doc_id reachable over links), kept (doc_id = component_id); a written table.

    Documents are linked if their sets of distinct 5-word shingles share percent of their union. Null texts, and texts
    without words, are linked with nothing. Rows of one doc_id are one document, whatever their texts; rows without
    doc_id are linked with nothing, and kept. Repeated rows come out as often as they come in. An empty table gives an
    empty one. Other columns are not read. With exact, no link is missed (see prefix_keys).
    """
    ship(docs.sparkSession)
    sig = materialise(signatures(docs, rows, bands))
    full = sig.where("n_shingles > 0 and doc_id is not null")
    # classes: equal words are one; of different words with equal hashes of the set, the sets are compared
    lists = materialise(full.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("c1", "c2", "n_shingles")]))
    copies = small(materialise(lists.where("n > 1").select("copy", "rep")))
    sets = ["c1", "c2", "n_shingles"]
    firsts = small(materialise(lists.groupBy(*sets).agg(F.min("rep").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")))
    equal = verified(lists.join(firsts, sets).where("rep <> u").select("u", F.col("rep").alias("v")), docs, 100)
    same = small(materialise(equal.groupBy(F.col("v").alias("of")).agg(F.min("u").alias("least"))))
    classed = full.join(copies, "copy", "left").withColumn("rep", F.coalesce("rep", "doc_id")).join(same, F.col("rep") == F.col("of"), "left").withColumn("class_id", F.coalesce("least", "rep")).drop("of", "least", "rep")
    reps = classed.where("class_id = doc_id")
    # candidates and their pivots
    keys = prefix_keys(docs, reps, percent) if exact else materialise(reps.select("doc_id", "n_shingles", F.explode("bands").alias("key")))
    buckets = small(materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")))
    shared = materialise(keys.join(buckets, "key"))
    scores = shared.groupBy("doc_id").agg(F.sum("n").alias("score"))
    pivots = small(materialise(shared.join(scores, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("u"))))
    links = verified(shared.join(pivots, "key").where("doc_id <> u").select("u", F.col("doc_id").alias("v")), docs, percent)
    label = small(components(links))
    # bands that still hold different components
    labelled = shared.where("n > 2").join(label, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label"))
    blocks = F.greatest(F.ceil(F.count("*") / _BLOCK), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES))
    mixed = small(materialise(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), blocks.alias("blocks")).where("low < high").select("key", "blocks")))
    members = more = None
    if not mixed.isEmpty():
        members = materialise(labelled.join(mixed, "key").select("key", "blocks", "doc_id", "label"))
        own = _shingles_of(docs, small(materialise(members.select("doc_id").distinct()))).join(reps.select(F.col("doc_id").alias("of"), "n_shingles", "bands", "sig"), F.col("doc_id") == F.col("of")).drop("of")
        more = verified(_across(members.join(own, "doc_id"), percent, None if exact else rows * bands), docs, percent)
    # rows of one doc_id tie the classes that they are in together
    twice = small(materialise(full.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")))
    tied = materialise(classed.join(twice, "doc_id", "left_semi").select(F.col("class_id").alias("u"), F.col("doc_id").alias("v")).where("u <> v").distinct())
    final = small(components(links.union(tied) if more is None else links.union(more).union(tied)))
    out = sig.join(copies, "copy", "left").withColumn("rep", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = out.join(same, F.col("rep") == F.col("of"), "left").withColumn("class_id", F.coalesce("least", "rep"))
    out = out.join(final, F.col("class_id") == F.col("node"), "left")
    component = F.coalesce("component", "class_id")
    out = materialise(out.select("doc_id", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(sig, lists, copies, firsts, equal, same, keys, buckets, shared, pivots, links, label, mixed, members, more, twice, tied, final)
    return out


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with their columns, of the least doc_id of each group of near-duplicates.

    Repeated rows of that doc_id all stay, as do rows without doc_id, without text or without words; an empty table stays
    empty. Columns of any name pass through.
    """
    judged = near_duplicates(docs, percent)
    gone = small(materialise(judged.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()))
    discard(judged)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
