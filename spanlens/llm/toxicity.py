"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

A word is the sum of the embeddings of its hash and of the hashes of its first 3, 4 and 5 bytes. Filters of several widths
slide over a text's words; the largest value of each filter feeds a logistic unit. A threshold for each language, which is
told from the letters of the text, is set on rows that weights were not fitted to; scores are shifted so that it
comes to CUT. All labelled rows that may be learnt from are: descent runs on groups of them at once, from the same start, and
the weights go by the mean of what groups that moved them did.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import by_bytes, joined, lower_bytes, mix, prefix_hashes, rows_of, span_hashes, texts, trim, word_spans

CUT = 0.3
WIDTHS, FILTERS, DIM, BITS = (1, 2, 3), 8, 8, 16
_PREFIXES = (0, 3, 4, 5)
_LOWER = lower_bytes()
_BATCH = 3 << 20
#: Bytes of texts that drop_toxic() scores at once.
_PART = 512 << 10
#: Steps of a logit in which thresholds are looked for.
CELLS = 256


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, np.int8)
    out[48:58] = out[65:91] = out[97:123] = out[128:] = 1
    return out


_WORD = _word_bytes()

#: Second bytes, after 0xC3, of letters that mark a language in UTF-8: German, French, Spanish; the rest count as a fourth.
_MARKS = ("äöüßÄÖÜ", "éèêçàùâîôûëïÉÈÊÇÀ", "ñáíóúÑÁÍÓÚ")


def _mark_table() -> np.ndarray:
    out = np.full(256, -1, np.int8)
    for i, letters in enumerate(_MARKS):
        out[[c.encode()[1] for c in letters]] = i
    return out


_MARK = _mark_table()


def languages(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0, 1 or 2 by the letters that a text has most of, 3 if it has none of them."""
    at = np.flatnonzero(data[:-1] == 0xC3)
    mark = _MARK[data[at + 1]]
    at, mark = at[mark >= 0], mark[mark >= 0]
    row = np.searchsorted(starts, at, "right") - 1
    n = np.bincount(row * 3 + mark, minlength=3 * (len(starts) - 1)).reshape(-1, 3)
    return np.where(n.sum(axis=1) > 0, n.argmax(axis=1), 3)


def word_ids(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the embedding table for each word, where each text's words start (the end last), and languages."""
    data, starts = joined(texts_)
    lang = languages(data, starts) if len(data) else np.zeros(0, np.int64)
    data = _LOWER[data]
    first, last = word_spans(data, _WORD)
    prefix = prefix_hashes(data)
    ids = np.empty((len(first), len(_PREFIXES)), np.int32)
    for j, n in enumerate(_PREFIXES):
        h = span_hashes(prefix, first, np.minimum(last, first + n) if n else last)
        ids[:, j] = mix(h + np.uint64(j)) >> np.uint64(64 - BITS)
    return ids, np.searchsorted(first, starts), lang


@dataclass
class Model:
    table: np.ndarray  # (2 ** BITS, DIM)
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray  # a threshold on the logit for each language

    def pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each text, at least 0; and the word where it begins (-1: none)."""
        n_docs = len(starts) - 1
        value = np.zeros((n_docs, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(value.shape, -1, np.int64) if where else None
        if not len(ids):
            return value, at
        emb = self.table[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            emb += self.table[ids[:, j]]
        for i, width in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            long = np.flatnonzero(np.diff(starts) >= width)
            if not len(long):
                continue
            n = len(ids) - width + 1
            act = emb[:n] @ self.filters[i][0]
            for j in range(1, width):
                act += emb[j : j + n] @ self.filters[i][j]
            act += self.bias[cols]
            # windows that cross into the next text don't count
            lo, hi = starts[long], starts[long + 1] - width + 1
            bounds = np.stack((lo, np.minimum(hi, n)), axis=1).ravel()
            if bounds[-1] == n:
                bounds = bounds[:-1]
            best = np.maximum.reduceat(act, bounds, axis=0)[::2]
            value[long, cols] = np.maximum(best, 0)
            if where:
                for d, a, b in zip(long, lo, hi, strict=True):
                    top = act[a:b].argmax(axis=0)
                    at[d, cols] = np.where(act[a + top, np.arange(FILTERS)] > 0, a + top, -1)
        return value, at

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(ids, starts)[0] @ self.out + self.out_bias

    def gradients(self, ids: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
        """Of the mean log loss of texts with labels y: by filters, bias and out; by out_bias; and the rows of the table
        that have one, with theirs. Only the window that gives a filter's largest value counts."""
        value, at = self.pooled(ids, starts, where=True)
        p = 1 / (1 + np.exp(-(value @ self.out + self.out_bias)))
        g = ((p - y) / len(y)).astype(np.float32)
        grads = [np.zeros_like(f) for f in self.filters] + [np.zeros_like(self.bias), value.T @ g]
        back = g[:, None] * self.out
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        for i, width in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            d, f = np.nonzero(at[:, cols] >= 0)
            w, gv = at[:, cols][d, f], back[:, cols][d, f]
            np.add.at(grads[len(WIDTHS)], i * FILTERS + f, gv)
            for j in range(width):
                rows_ = ids[w + j]
                emb = self.table[rows_].sum(axis=1)
                np.add.at(grads[i][j].T, f, gv[:, None] * emb)
                gathered.append((rows_, gv[:, None] * self.filters[i][j][:, f].T))
        touched = np.concatenate([r.ravel() for r, _ in gathered])
        change = np.concatenate([np.repeat(c, len(_PREFIXES), axis=0) for _, c in gathered])
        which, back_ = np.unique(touched, return_inverse=True)
        total = np.zeros((len(which), DIM), np.float32)
        np.add.at(total, back_, change)
        return grads, float(g.sum()), which, total

    def scores(self, texts_: list[bytes]) -> np.ndarray:
        """Of whole texts, 0 to 1; CUT is where a language's threshold lies. A text without words scores lowest."""
        ids, starts, lang = word_ids(texts_)
        z = self.logits(ids, starts).astype(np.float64) - self.cuts[lang] + np.log(CUT / (1 - CUT))
        z[np.diff(starts) == 0] = -40
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _threshold(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The logit, halfway between two of z, from which calling rows toxic gives the best F1; ties: the widest gap. Clean
    and toxic are numbers of rows that have a logit."""
    z, at = np.unique(z, return_inverse=True)
    clean, toxic = (np.bincount(at, n, len(z)) for n in (clean, toxic))
    hits, called = (n.sum() - np.concatenate(([0], np.cumsum(n)))[:-1] for n in (toxic, clean + toxic))
    f1 = 2 * hits / np.maximum(called + toxic.sum(), 1)
    low = np.concatenate(([z[0] - 2], z[:-1]))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = best[np.argmax((z - low)[best])]
    return float((z[i] + low[i]) / 2)


def _set_cuts(model: Model, z: np.ndarray, clean: np.ndarray, toxic: np.ndarray, lang: np.ndarray, least: int) -> None:
    """Thresholds from logits and the numbers of rows that have them; a language with fewer than least of a label takes that of all."""
    model.cuts[:] = _threshold(z, clean, toxic) if toxic.sum() else np.log(CUT / (1 - CUT))
    for code in range(4):
        mine = lang == code
        if min(clean[mine].sum(), toxic[mine].sum()) >= least:
            model.cuts[code] = _threshold(z[mine], clean[mine], toxic[mine])


def _new_model(rng: np.random.Generator) -> Model:
    """Weights to start from, before _give_odds."""
    table = (rng.standard_normal((1 << BITS, DIM)) * 0.05).astype(np.float32)
    filters = [(rng.standard_normal((w, DIM, FILTERS)) * (0.5 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS]
    out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
    return Model(table, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), out, 0.0, np.zeros(4))


def _one_label(model: Model, toxic: bool) -> Model:
    """The model of rows with one label or none: each text is called toxic, or none is."""
    model.out[:] = 0
    model.cuts[:] = -1.0 if toxic else 1.0
    return model


def _hashed(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_ids() of some texts at once: hashing takes many times their bytes."""
    parts = [word_ids(group) for group in by_bytes(iter(texts_), 1 << 19, lambda t: len(t) + 64)]
    ids, lang = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    ends = np.concatenate([p[1][1:] + n for p, n in zip(parts, np.cumsum([0, *[len(p[0]) for p in parts[:-1]]]), strict=True)])
    return ids, np.concatenate(([0], ends)), lang


def _texts_with(ids: np.ndarray, starts: np.ndarray, y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """For each label and hash, the number of texts that have it."""
    n = np.zeros((2, 1 << BITS), np.int64)
    for d in train:
        n[int(y[d]), np.unique(ids[starts[d] : starts[d + 1]])] += 1
    return n


def _give_odds(model: Model, n: np.ndarray, sizes: np.ndarray) -> None:
    """The first dimension starts as the log odds of texts that have the hash, so that filters meet telling words at once."""
    sizes = sizes + 1.0
    odds = np.log((n[1] + 0.5) / sizes[1]) - np.log((n[0] + 0.5) / sizes[0])
    model.table[:, 0] = np.clip(odds, -4, 4) * 0.25
    for f in model.filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5
    model.out[:] = np.abs(model.out)


def _descend(model: Model, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, train: np.ndarray, rng: np.random.Generator, steps: int, batch: int, rate: float) -> None:
    """Whole passes over the texts of train, until there were steps."""
    params = [*model.filters, model.bias, model.out]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bias_state, table_square, step = [0.0, 0.0], np.zeros(1 << BITS, np.float32), 0
    while step < steps:
        for part in np.array_split(rng.permutation(train), max(1, len(train) // batch)):
            step += 1
            own = np.concatenate([ids[starts[d] : starts[d + 1]] for d in part])
            begin = np.concatenate(([0], np.cumsum([starts[d + 1] - starts[d] for d in part])))
            grads, gb, which, total = model.gradients(own, begin, y[part])
            for q, grad, (m, v) in zip(params, grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            bias_state = [0.9 * bias_state[0] + 0.1 * gb, 0.999 * bias_state[1] + 0.001 * gb * gb]
            model.out_bias -= rate * (bias_state[0] / (1 - 0.9**step)) / (np.sqrt(bias_state[1] / (1 - 0.999**step)) + 1e-8)
            table_square[which] += (total * total).mean(axis=1)
            model.table[which] -= rate * total / (np.sqrt(table_square[which])[:, None] + 1e-6)


def fit(rows: list[tuple[bytes, int]], steps: int = 240, batch: int = 48, rate: float = 0.01, seed: int = 11, least: int = 10) -> Model:
    """A model of (text, label) rows, three quarters for the weights and the rest, every fourth, for thresholds.

    With fewer than least rows of either label among these, thresholds are set on all rows; a language with fewer than
    least takes the threshold of all. With one label only, no
    text is called toxic, or each is.
    """
    rng = np.random.default_rng(seed)
    model = _new_model(rng)
    y = np.array([label for _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return _one_label(model, bool(len(y) and y.max() == 1))
    ids, starts, lang = _hashed([t for t, _ in rows])
    train = np.flatnonzero(np.arange(len(y)) % 4 != 3)
    _give_odds(model, _texts_with(ids, starts, y, train), np.bincount(y[train].astype(int), minlength=2))
    _descend(model, ids, starts, y, train, rng, steps, batch, rate)
    held = np.flatnonzero(np.arange(len(y)) % 4 == 3)
    if min(y[held].sum(), (1 - y[held]).sum()) < least:
        held = np.arange(len(y))
    z = np.array([model.logits(ids[starts[d] : starts[d + 1]], np.array([0, starts[d + 1] - starts[d]]))[0] for d in held], np.float64)
    _set_cuts(model, z, 1 - y[held], y[held], lang[held], least)
    return model


def held_out() -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def _flat(model: Model) -> np.ndarray:
    """All weights but the table's, in rows of DIM."""
    flat = np.concatenate([*[f.ravel() for f in model.filters], model.bias, model.out, [model.out_bias]]).astype(np.float64)
    return np.concatenate((flat, np.zeros(-len(flat) % DIM))).reshape(-1, DIM)


def _add_flat(model: Model, change: np.ndarray) -> None:
    change, at = change.ravel(), 0
    for p in (*model.filters, model.bias, model.out):
        p += change[at : at + p.size].reshape(p.shape).astype(np.float32)
        at += p.size
    model.out_bias += float(change[at])


_SUMS = ["clean", "toxic", "groups", *[f"d{j}" for j in range(DIM)]]


class Learnt:
    """What groups of rows have taught, as whole numbers, whose sum no order of groups changes.

    A row for each hash, then those of _flat, then one for all: numbers of clean and toxic texts that have the hash; of
    groups whose weights it moved; and by how much they did, in all, in units of 1 / UNIT.
    """

    UNIT = 1 << 30
    ROWS = (1 << BITS) + -(-(DIM * FILTERS * sum(WIDTHS) + 2 * FILTERS * len(WIDTHS) + 1) // DIM) + 1

    def __init__(self, sums: np.ndarray | None = None) -> None:
        self.sums = np.zeros((self.ROWS, len(_SUMS)), np.int64) if sums is None else sums

    def add(self, texts_: list[bytes], labels: list[int], steps: int = 240, batch: int = 48, rate: float = 0.01, seed: int = 11) -> None:
        """One group: its counts, and with both labels how far descent from its own log odds moves the weights."""
        y = np.array(labels, np.float32)
        ids, starts, _ = _hashed(texts_)
        every = np.arange(len(y))
        n, sizes = _texts_with(ids, starts, y, every), np.bincount(y.astype(int), minlength=2)
        self.sums[: 1 << BITS, :2] += n.T
        self.sums[-1, :2] += sizes
        if not sizes.all():
            return
        rng = np.random.default_rng(seed)
        model = _new_model(rng)
        _give_odds(model, n, sizes)
        table, flat = model.table.copy(), _flat(model)
        _descend(model, ids, starts, y, every, rng, steps, batch, rate)
        moves = np.concatenate((model.table.astype(np.float64) - table, _flat(model) - flat))
        moved = np.flatnonzero(moves.any(axis=1))
        self.sums[moved, 2] += 1
        self.sums[moved, 3:] += np.rint(moves[moved] * self.UNIT).astype(np.int64)

    def model(self, seed: int = 11) -> Model:
        """From the log odds of all rows, weights go by the mean of the groups that moved them."""
        model = _new_model(np.random.default_rng(seed))
        _give_odds(model, self.sums[: 1 << BITS, :2].T, self.sums[-1, :2])
        mean = self.sums[:-1, 3:] / (self.UNIT * np.maximum(self.sums[:-1, 2:3], 1))
        model.table += mean[: 1 << BITS].astype(np.float32)
        _add_flat(model, mean[1 << BITS :])
        return model


def _labelled(docs: DataFrame, labels: DataFrame, part: Column, groups: int) -> DataFrame:
    """grp, text, toxic of each doc_id for which part holds and both are known, by grp and doc_id in each partition.

    Texts and labels are dealt to groups by doc_id and meet there: neither is broadcast, and a text is shuffled once. As
    many partitions as groups, at least, keep tasks from growing with the tables.
    """
    partitions = max(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.lit(1).alias("kind"), F.xxhash64("text").alias("tie"), F.lit(None).cast("int").alias("toxic"), "text").unionByName(
        labels.select("doc_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "toxic", F.lit(None).cast("string").alias("text"))
    )
    own = Window.partitionBy("grp", "doc_id").orderBy("kind", "tie")
    # after the labels of a doc_id comes the one of its texts that counts
    rows = rows.where(part).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(groups)).cast("int")).repartition(partitions, "grp")
    rows = rows.select("grp", "doc_id", "kind", "text", F.lag("kind").over(own).alias("before"), F.max("toxic").over(own).alias("toxic"))
    return rows.where("kind = 1 and before = 0").sortWithinPartitions("grp", "doc_id").select("grp", "text", "toxic")


def fit_labelled(docs: DataFrame, labels: DataFrame, group_bytes: int = 8 << 20, least: int = 10) -> Model:
    """A model fitted to the whole texts of all rows with a label (doc_id, toxic) that are not held out.

    Three quarters of them, dealt by doc_id, are for the weights. They go in groups of about group_bytes, each of which
    is held by one task; groups differ from each other by their rows only, so how tables are partitioned
    changes nothing. The other quarter is for thresholds, on logits rounded to 1 / CELLS; with fewer than least rows of
    either label in it, all rows are for both.

    Rows without doc_id, text or label are left out; a doc_id with several labels counts as toxic if one says so, and
    one with several texts is known by one of these. Repeated rows count once.
    """
    spark = docs.sparkSession
    ship(spark)
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    docs = docs.where("doc_id is not null and text is not null").where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    n, weight = np.zeros((2, 2), np.int64), [0, 0]  # by aside; then by label
    for r in sizes.groupBy(aside.alias("aside"), "toxic").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect():
        n[int(r["aside"]), r["toxic"]] = r["n"]
        weight[int(r["aside"])] += r["bytes"]
    if not n.sum(axis=0).all():
        return _one_label(_new_model(np.random.default_rng(11)), bool(n[:, 1].any()))
    split = n.min() >= least
    groups, groups_aside = (max(1, round((w if split else sum(weight)) / group_bytes)) for w in weight)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = None
        for _, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            texts_, labels_ = zip(*[r[1:] for r in rows], strict=True)
            learnt = learnt or Learnt()
            learnt.add(list(texts_), list(labels_))
            del texts_, labels_
            trim()
        if learnt:
            at = np.flatnonzero(learnt.sums.any(axis=1))
            for i in range(0, len(at), 10_000):
                some = at[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(learnt.sums[some, j]) for j in range(len(_SUMS))]], names=["id", *_SUMS])

    rows = _labelled(docs, labels, ~aside if split else F.lit(True), groups)
    sums = rows.mapInArrow(learn, "id int, " + ", ".join(f"{c} long" for c in _SUMS)).groupBy("id").agg(*[F.sum(c).alias(c) for c in _SUMS]).toArrow()
    learnt = Learnt()
    learnt.sums[sums["id"].to_numpy()] = np.stack([sums[c].to_numpy() for c in _SUMS], axis=1)
    model = learnt.model()
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = shared.value, Counter()
        for group in by_bytes(rows_of(batches), _PART, lambda r: len(r[1]) + 64):
            ids, starts, lang = word_ids([t for _, t, _ in group])
            cells = np.rint(np.clip(model.logits(ids, starts).astype(np.float64), -40, 40) * CELLS).astype(int)
            found.update(zip(lang.tolist(), cells.tolist(), [y for _, _, y in group], strict=True))
        columns = np.array([(*k, v) for k, v in found.items()], np.int64).reshape(-1, 4).T
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "cell", "toxic", "n"])

    # these are judged one by one, so that smaller groups do, which spread over more tasks
    rows = _labelled(docs, labels, aside if split else F.lit(True), 8 * groups_aside)
    found = rows.mapInArrow(judge, "lang long, cell long, toxic long, n long").groupBy("lang", "cell", "toxic").agg(F.sum("n").alias("n")).orderBy("lang", "cell", "toxic").toArrow()
    lang, cell, toxic, count = (found[c].to_numpy() for c in ("lang", "cell", "toxic", "n"))
    _set_cuts(model, cell / CELLS, count * (toxic == 0), count * (toxic == 1), lang, least)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted (1 if score >= CUT) for each row of docs (doc_id, text), repeated ones too; equal texts
    have equal scores. Null and empty texts, and texts without words, score lowest. Other columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value

        for group in by_bytes(rows_of(batches), _BATCH, lambda r: len(r[1]) + 64):
            s = model.scores([t for _, t in group])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with their columns of whatever names, that the classifier doesn't call toxic. Null and empty texts
    stay, and repeated rows share their fate."""
    model = fit_labelled(docs, labels)
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            trim()
            column = batch.column(at)
            # few texts at once: hashing takes many times their bytes
            sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for group in by_bytes(enumerate(sizes), _PART, lambda r: r[1] + 64):
                part = batch.slice(group[0][0], len(group))
                texts_ = [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(model.scores(texts_) < CUT))

    return docs.mapInArrow(run, docs.schema)
