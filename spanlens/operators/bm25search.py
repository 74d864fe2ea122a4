"""BM25 of queries that fit in memory: each text meets all of them where it lies, so that neither texts, postings nor
scores are shuffled. Postings are written as one row for a text."""

from __future__ import annotations

import ctypes
from bisect import bisect_left
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..storage import materialise

#: So many tokens, hits of terms and queries, and scores are held at once; a text that has more is held alone.
TOKENS, HITS, CELLS = 200_000, 500_000, 500_000
#: n-grams of so many words are kept by a worker.
WORDS = 100_000


def places9(x: np.ndarray) -> np.ndarray:
    """x, at least 0, in units of 1e-9 as round(x, 9) of SQL gives it: halves of the shortest decimal go up."""
    y = x * 1e9
    low = np.floor(y)
    out = np.floor(y + 0.5).astype(np.int64)
    for i in zip(*np.nonzero(np.abs(y - low - 0.5) < 1e-3), strict=True):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(9).to_integral_value(ROUND_HALF_UP))
    return out


def _trim() -> None:
    """Gives memory that is free in this worker back, where glibc can."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive items whose sizes come to about limit."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often they stand or the sums of n."""
    if n is None:
        return np.unique(key, return_counts=True)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Grams:
    """Numbers of the terms among a word's n-grams, each as often as it stands there."""

    def __init__(self, terms: pa.Array, sizes: tuple[int, int]):
        self.of, self.sizes, self.known = {t: i for i, t in enumerate(terms.to_pylist())}, sizes, {}

    def __call__(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            n = len(word)
            low, high = self.sizes
            every = [word] if n < low else [word[i : i + k] for k in range(low, min(high, n) + 1) for i in range(n - k + 1)]
            got = [t for t in map(self.of.get, every) if t is not None]
            if len(self.known) >= WORDS:
                self.known.clear()
            self.known[word] = got
        return got


class Search:
    """Queries (query_id, scope, term, qtf; wanted, a table that fits in memory) against docs (scope, doc_id, dl, tokens and
    columns to keep); grams as in BM25Index.

    table: scope, doc_id, dl, terms, tfs and the kept columns, a written row for each row of docs. Rows that repeat a
    doc_id stand for themselves.
    """

    def __init__(self, docs: DataFrame, wanted: DataFrame, k1: float, b: float, grams: tuple[int, int] | None):
        self.spark = docs.sparkSession
        ship(self.spark)
        asked = wanted.where("scope is not null").select("query_id", F.col("scope").cast("string").alias("scope"), "term", "qtf").toArrow()
        self.types = {"query_id": wanted.schema["query_id"].dataType, "scope": T.StringType(), "doc_id": docs.schema["doc_id"].dataType}
        asked = asked.sort_by([("scope", "ascending"), ("query_id", "ascending"), ("term", "ascending")])
        column = {c: pa.concat_arrays(asked[c].chunks) if asked[c].num_chunks else pa.array([], asked[c].type) for c in asked.column_names}
        self.terms, self.scopes = pc.unique(column["term"].drop_null()), pc.unique(column["scope"])
        scope, name = _numbers(column["scope"], self.scopes), column["query_id"].to_pylist()
        # a query in a scope is a number; one without terms has one too
        first = np.array([i for i in range(len(name)) if not i or name[i] != name[i - 1] or scope[i] != scope[i - 1]], np.int64)
        self.ids, self.query_scope = column["query_id"].take(pa.array(first)), scope[first]
        query = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
        some = np.asarray(column["term"].is_valid())
        term, scope, self.query = _numbers(column["term"], self.terms)[some], scope[some], query[some]
        self.pairs = np.unique(scope * max(len(self.terms), 1) + term)
        self.kept = [c for c in docs.columns if c not in ("scope", "doc_id", "dl", "tokens")]
        self.table = materialise(docs.withColumn("scope", F.col("scope").cast("string")).mapInArrow(self._post(grams), self._schema(docs)))
        self.model = self._weigh(term, scope, np.asarray(column["qtf"], np.float64)[some], k1, b)

    def _schema(self, docs: DataFrame) -> T.StructType:
        numbers = T.ArrayType(T.IntegerType())
        return T.StructType([T.StructField("scope", T.StringType()), docs.schema["doc_id"], docs.schema["dl"], T.StructField("terms", numbers), T.StructField("tfs", numbers), *[docs.schema[c] for c in self.kept]])

    def _post(self, sizes: tuple[int, int] | None) -> Callable:
        shared, kept = self.spark.sparkContext.broadcast((self.terms, self.scopes, self.pairs)), self.kept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, scopes, pairs = shared.value
            grams = _Grams(terms, sizes) if sizes else None
            for batch in batches:
                _trim()
                tokens = batch.column(batch.schema.get_field_index("tokens"))
                for a, b in _cuts(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)) + 1, TOKENS):
                    part = batch.slice(a, b - a)
                    doc, term, tf = _postings(part.column("tokens"), terms, grams)
                    if len(scopes) > 1 and len(doc):
                        scope = _numbers(part.column("scope"), scopes)[doc]
                        own = (scope >= 0) & np.isin(scope * len(terms) + term, pairs)
                        doc, term, tf = doc[own], term[own], tf[own]
                    at = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, tf)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("scope", "doc_id", "dl")), *lists, *(part.column(c) for c in kept)], names=["scope", "doc_id", "dl", "terms", "tfs", *kept])
            del grams
            _trim()

        return run

    def _weigh(self, term: np.ndarray, scope: np.ndarray, qtf: np.ndarray, k1: float, b: float) -> dict:
        n_terms = max(len(self.terms), 1)
        here = self.table.where(F.col("scope").isin(self.scopes.to_pylist())) if len(self.scopes) <= 100 else self.table
        stats = {r["scope"]: r for r in here.groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("a")).collect()}
        n = np.array([stats[s]["n"] if s in stats else 0 for s in self.scopes.to_pylist()], np.float64)
        mean = np.array([(stats[s]["a"] or 0.0) if s in stats else 0.0 for s in self.scopes.to_pylist()], np.float64)
        df = np.zeros(len(self.pairs))
        found = here.select("scope", F.explode("terms").alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df")).toArrow()
        if found.num_rows:
            pair = _numbers(found["scope"].combine_chunks(), self.scopes) * n_terms + np.asarray(found["term"])
            df[np.searchsorted(self.pairs, pair)] = np.asarray(found["df"])
        pair = np.searchsorted(self.pairs, scope * n_terms + term)
        idf = np.log(1.0 + (n[scope] - df[pair] + 0.5) / (df[pair] + 0.5))
        order = np.argsort(pair, kind="stable")
        starts = np.searchsorted(pair[order], np.arange(len(self.pairs) + 1))
        return {"n_terms": n_terms, "pairs": self.pairs, "scopes": self.scopes, "mean": mean, "starts": starts, "query": self.query[order], "weight": (qtf * idf)[order], "ids": self.ids, "query_scope": self.query_scope, "k1": k1, "b": b}

    def _run(self, rows: DataFrame, columns: list[tuple[str, T.DataType]], each: Callable, *more: object) -> DataFrame:
        shared = self.spark.sparkContext.broadcast((self.model, more))
        schema = T.StructType([T.StructField(n, t) for n, t in columns])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, more = shared.value
            for batch in batches:
                _trim()
                # postings of a whole batch would take several numbers each at once
                for a, b in _cuts(np.asarray(pc.fill_null(pc.list_value_length(batch.column(3)), 0)).astype(np.int64) + 1, HITS):
                    for block in _blocks(batch.slice(a, b - a), model):
                        got = each(model, *block, *more)
                        if len(got[0]):
                            yield pa.RecordBatch.from_arrays(got, names=schema.names)
            _trim()

        return rows.select("scope", "doc_id", "dl", "terms", "tfs").mapInArrow(run, schema)

    def scores(self, rows: DataFrame | None = None) -> DataFrame:
        """query_id, scope, doc_id, score of the rows of table, or some of them, that share a term with a query."""
        return self._run(self.table if rows is None else rows, [*self.types.items(), ("score", T.DoubleType())], _every)

    def top(self, k: int) -> DataFrame:
        """The same, with the first k of each query among them; others may follow."""
        return self._run(self.table, [*self.types.items(), ("score", T.DoubleType())], _first, k)

    def ahead(self, places: dict[object, list[tuple[float, object] | None]], names: list[str]) -> DataFrame:
        """query_id and for each of names the number of documents, those at score 0 too, that go before a place (score
        rounded to 9 places, doc_id) in the ranking of a query in its scope; null without a place. places: by query_id."""
        of = [places.get(i) for i in self.ids.to_pylist()]
        parts = self._run(self.table, [("query_id", self.types["query_id"]), *[(n, T.LongType()) for n in names]], _before, of, len(names))
        return parts.groupBy("query_id").agg(*[F.sum(n).alias(n) for n in names])


def _numbers(values: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each value in among, or -1."""
    return np.asarray(pc.fill_null(pc.index_in(values, value_set=among.cast(values.type)), -1)).astype(np.int64)


def _postings(tokens: pa.Array, terms: pa.Array, grams: _Grams | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the term, and how often it stands there, by row and term."""
    n = max(len(terms), 1)
    row, flat = np.asarray(pc.list_parent_indices(tokens)).astype(np.int64), pc.list_flatten(tokens)
    if grams is None:
        term = _numbers(flat, terms)
        key, tf = _counted(row[term >= 0] * n + term[term >= 0])
        return key // n, key % n, tf
    flat = pc.dictionary_encode(flat)
    here = np.asarray(flat.indices.is_valid())
    words = flat.dictionary.to_pylist()
    of = [grams(w) for w in words]
    sizes = np.array([len(g) for g in of], np.int64)
    held = np.array([t for g in of for t in g], np.int64)
    starts = np.cumsum(sizes) - sizes
    key, count = _counted(row[here] * max(len(words), 1) + np.asarray(pc.fill_null(flat.indices, 0)).astype(np.int64)[here])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    row, word = key // max(len(words), 1), key % max(len(words), 1)
    # whole rows at once, so that a row's terms meet in one part
    per_row = np.bincount(row, sizes[word], minlength=len(tokens)).astype(np.int64)
    for a, b in _cuts(per_row, HITS):
        i, j = np.searchsorted(row, (a, b))
        w = word[i:j]
        cell, tf = (np.repeat(row[i:j], sizes[w]) - a) * n + held[_ranges(starts[w], sizes[w])], np.repeat(count[i:j], sizes[w])
        if (b - a) * n <= 8 * len(cell):
            # a table of all cells costs less than a sort
            sums = np.bincount(cell, tf, minlength=(b - a) * n)
            cell = np.flatnonzero(sums)
            tf = sums[cell].astype(np.int64)
        else:
            cell, tf = _counted(cell, tf)
        out.append((cell + a * n, tf))
    key, tf = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), ())))
    return key // n, key % n, tf


def _blocks(batch: pa.RecordBatch, model: dict) -> Iterator[tuple]:
    """doc_ids in ascending order, scope, its queries and the scores (documents by queries) of some rows at once."""
    scopes = _numbers(batch.column("scope"), model["scopes"])
    for s in np.unique(scopes[scopes >= 0]):
        rows = batch.take(pa.array(np.flatnonzero(scopes == s)))
        queries = np.flatnonzero(model["query_scope"] == s)
        first, n_q = queries[0], len(queries)
        size = np.asarray(pc.fill_null(pc.list_value_length(rows.column("terms")), 0)).astype(np.int64)
        pair = np.searchsorted(model["pairs"], s * model["n_terms"] + np.asarray(pc.list_flatten(rows.column("terms"))).astype(np.int64))
        tf = np.asarray(pc.list_flatten(rows.column("tfs"))).astype(np.float64)
        dl = np.asarray(pc.fill_null(rows.column("dl"), 0)).astype(np.float64)
        mean, k1, b = model["mean"][s], model["k1"], model["b"]
        norm = k1 * ((1 - b) + b * dl / mean) if mean else np.full(len(dl), k1)
        hits = model["starts"][pair + 1] - model["starts"][pair]
        ends = np.cumsum(size)
        cost = np.bincount(np.repeat(np.arange(len(size)), size), hits, minlength=len(size)).astype(np.int64)
        for a, z in _cuts(np.maximum(cost, n_q * HITS // CELLS), HITS):
            lo, hi = (ends[a - 1] if a else 0), ends[z - 1]
            doc = np.repeat(np.arange(z - a), size[a:z])
            in_doc = tf[lo:hi] * (k1 + 1) / (tf[lo:hi] + norm[a:z][doc])
            n = hits[lo:hi]
            at = _ranges(model["starts"][pair[lo:hi]], n)
            score = np.bincount(np.repeat(doc, n) * n_q + (model["query"][at] - first), model["weight"][at] * np.repeat(in_doc, n), minlength=(z - a) * n_q).reshape(z - a, n_q)
            ids = rows.column("doc_id").slice(a, z - a)
            order = pc.sort_indices(ids, null_placement="at_start")
            yield ids.take(order), rows.column("scope").slice(a, z - a), queries, score[np.asarray(order)]


def _rows(model: dict, ids: pa.Array, scope: pa.Array, queries: np.ndarray, score: np.ndarray, doc: np.ndarray, q: np.ndarray) -> list[pa.Array]:
    return [model["ids"].take(pa.array(queries[q])), scope.take(pa.array(np.zeros(len(doc), np.int64))), ids.take(pa.array(doc)), pa.array(score[doc, q])]


def _every(model: dict, ids: pa.Array, scope: pa.Array, queries: np.ndarray, score: np.ndarray) -> list[pa.Array]:
    return _rows(model, ids, scope, queries, score, *np.nonzero(score))


def _first(model: dict, ids: pa.Array, scope: pa.Array, queries: np.ndarray, score: np.ndarray, k: int) -> list[pa.Array]:
    nine = places9(score)
    docs, qs = [], []
    for q in range(len(queries)):
        col, shares = nine[:, q], score[:, q] > 0
        if shares.sum() > k:
            last = np.partition(col[shares], -k)[-k]
            more = np.flatnonzero(shares & (col > last))
            # of equal scores, the least doc_ids
            own = np.concatenate((more, np.flatnonzero(shares & (col == last))[: k - len(more)]))
        else:
            own = np.flatnonzero(shares)
        docs.append(own)
        qs.append(np.full(len(own), q))
    return _rows(model, ids, scope, queries, score, np.concatenate(docs), np.concatenate(qs))


def _before(model: dict, ids: pa.Array, scope: pa.Array, queries: np.ndarray, score: np.ndarray, places: list, n: int) -> list[pa.Array]:
    nine, held = places9(score), ids.drop_null().to_pylist()
    out: list[list[int | None]] = []
    for q in range(len(queries)):
        col, counts = nine[:, q], []
        for place in places[queries[q]] or [None] * n:
            if place is None:
                counts.append(None)
                continue
            at, x = len(ids) - len(held) + bisect_left(held, place[1]), round(place[0] * 1e9)
            counts.append(int((col > x).sum() + (col[:at] == x).sum()))
        out.append(counts)
    return [model["ids"].take(pa.array(queries)), *[pa.array([r[i] for r in out], pa.int64()) for i in range(n)]]
