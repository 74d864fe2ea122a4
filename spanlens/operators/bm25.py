"""BM25 over an inverted index in DataFrames. Statistics are kept for each scope: '*' for one open corpus, or a text's
own id for rankings inside each text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import n_word_ngrams, word_ngrams
from ..storage import materialise, small
from .bm25search import Search

K1, B = 1.5, 0.75
#: Up to so many rows of queries' terms are held by each worker, and texts meet them where they lie; with more, postings are joined by shuffle.
ASKED_ROWS = 200_000


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """tf (k1 + 1) / (tf + norm); where the mean length is 0, norm is k1."""
    norm = F.when(avgdl == 0, F.lit(k1)).otherwise(F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.try_divide(dl.cast("double"), avgdl)))
    return tf * F.lit(k1 + 1) / (tf + norm)


class BM25Index:
    """docs: scope, doc_id, tokens. Empty documents count in the number of documents and the mean length.

    With grams, tokens are words, and terms are their character n-grams of grams[0] to grams[1] letters. These are made
    once for each distinct word, not for each place where it stands. keep: further columns of docs that search().table has.
    """

    def __init__(self, docs: DataFrame, k1: float = K1, b: float = B, grams: tuple[int, int] | None = None, keep: tuple[str, ...] = ()):
        self.all, self.keep = docs, keep
        self.docs, self.k1, self.b, self.grams = docs.select("scope", "doc_id", "tokens"), k1, b, grams
        length = F.size("tokens") if grams is None else F.aggregate("tokens", F.lit(0), lambda n, w: n + n_word_ngrams(F.length(w), *grams))
        self.length = length.alias("dl")
        self.sized = self.docs.select("scope", "doc_id", self.length, "tokens")
        self.lengths = self.sized.select("scope", "doc_id", "dl")
        self.searched: list[tuple[DataFrame, DataFrame, Search | None]] = []
        self.scopes = self.lengths.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def _wanted(self, queries: DataFrame) -> tuple[DataFrame, Search | None]:
        for known, wanted, search in self.searched:
            if known is queries:
                return wanted, search
        # a query without tokens has a row too
        wanted = materialise(queries.select("query_id", "scope", F.explode_outer("tokens").alias("term")).groupBy("query_id", "scope", "term").agg(F.count("*").alias("qtf")))
        search = None
        if wanted.count() <= ASKED_ROWS:
            search = Search(self.all.select("scope", "doc_id", self.length, "tokens", *self.keep), wanted, self.k1, self.b, self.grams)
        self.searched.append((queries, wanted, search))
        return wanted, search

    def search(self, queries: DataFrame) -> Search | None:
        """The index of these queries' terms, written once for each DataFrame of queries; None if they are too many to be held."""
        return self._wanted(queries)[1]

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """scope, doc_id, dl, term, tf; only of terms (scope, term), if given: nothing else of the corpus is shuffled."""
        key = ["scope", "doc_id", "dl"]
        if self.grams is None:
            long = self.sized.select(*key, F.explode("tokens").alias("term"))
            if terms is not None:
                long = long.join(terms, ["scope", "term"], "left_semi")
            return long.groupBy(*key, "term").agg(F.count("*").alias("tf"))
        # a document's words stay in one partition from here on, so its counts need no further shuffle
        placed = self.sized.repartition("scope", "doc_id").select(*key, F.explode("tokens").alias("word"))
        counts = placed.groupBy(*key, "word").agg(F.count("*").alias("c"))
        grams = self.docs.select("scope", F.explode("tokens").alias("word")).distinct().select("scope", "word", F.explode(word_ngrams(F.array("word"), *self.grams)).alias("term"))
        if terms is not None:
            grams = grams.join(terms, ["scope", "term"], "left_semi")
        grams = small(materialise(grams.groupBy("scope", "word", "term").agg(F.count("*").alias("m"))))
        return counts.join(grams, ["scope", "word"]).groupBy(*key, "term").agg(F.sum(F.col("c") * F.col("m")).alias("tf"))

    def score(self, queries: DataFrame) -> DataFrame:
        """query_id, scope, doc_id, score of documents that share a term with queries (query_id, scope, tokens); a query's
        repeated term counts as often as it stands. With grams, a query's tokens are n-grams.

        Postings of the queries' terms are written once, as document frequencies and scores both read them.
        """
        wanted, search = self._wanted(queries)
        if search:
            return search.scores().groupBy("query_id", "scope", "doc_id").agg(F.max("score").alias("score"))
        terms = small(materialise(wanted.select("scope", "term").distinct()))
        scopes = small(materialise(self.scopes))
        postings = materialise(self.postings(terms))
        df = postings.groupBy("scope", "term").agg(F.count("*").alias("df")).join(scopes, "scope")
        asked = wanted.join(df, ["scope", "term"]).select("query_id", "scope", "term", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("weight"))
        weighed = postings.join(scopes, "scope").select("scope", "doc_id", "term", term_weight(F.col("tf"), F.col("dl"), F.col("avgdl"), self.k1, self.b).alias("in_doc"))
        hits = weighed.join(small(materialise(asked)), ["scope", "term"])
        return hits.groupBy("query_id", "scope", "doc_id").agg(F.sum(F.col("weight") * F.col("in_doc")).alias("score"))

    def rank(self, queries: DataFrame, k: int | None = None, fill: bool = True, scored: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: by score rounded to 9 places, then doc_id. scored: of score(), if there already.

        The full ranking holds every document of the scope, those without a shared term at score 0. With k only the
        first k are made. Where fewer than k share a term, the least doc_ids of the scope follow at score 0, of which k
        are looked at; without fill, they don't.
        """
        if k is not None and k <= 0:
            raise ValueError("k must be at least 1")
        search = self.search(queries) if scored is None else None
        if scored is None:
            scored = self.score(queries) if search is None or k is None else search.top(k)
        listed = search.table if search else self.docs
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("doc_id"))
        if k is not None:
            top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
            if not fill:
                return top if search is None else top.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
            place = F.row_number().over(Window.partitionBy("scope").orderBy("doc_id"))
            least = listed.select("scope", "doc_id", place.alias("place")).where(F.col("place") <= k).drop("place")
            zeros = queries.select("query_id", "scope").join(least, "scope").select("query_id", "doc_id", F.lit(0.0).alias("score"))
            filled = top.drop("rank").union(zeros).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
            return filled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        every = queries.select("query_id", "scope").join(listed.select("scope", "doc_id"), "scope")
        full = every.join(scored, ["query_id", "scope", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return full.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")
