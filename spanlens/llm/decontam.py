"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds postings (term, document, position) of the corpus for those terms that searches start from: the two
rarest of each benchmark window. A window's two posting lists are moved by the terms' places in the window and
intersected. That settles windows of one or two words; longer ones are compared with the words of the documents that are
left, each of which is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lower_ascii, materialise, texts

#: A word is a run of a-z, 0-9 and characters beyond ASCII, after A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is not of a word, before lower-casing.
NOT_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many rows, a table of terms, windows or documents is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def n_words(text: Column) -> Column:
    """How many words() a text has: pieces between what is no word, without the empty ones at its ends."""
    pieces = F.split(text, NOT_ANY_CASE)
    return F.size(F.array_remove(pieces, "")).cast("long")


def small(df: DataFrame) -> DataFrame:
    """df, a written table, to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """window (its words) and item_id (string; null: empty) for each window of size consecutive words; an item of
    fewer words, but not none, is one window. Equal rows come once."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))).alias("at")
    return w.select("item_id", "w", start).select("item_id", F.slice("w", F.col("at"), size).alias("window")).distinct()


class Index:
    """Postings of docs (doc_id, text) for a benchmark's (item_id, text) windows.

    A row of docs is known by doc_id and a hash of its text, so repeated rows have the same postings. Null texts have
    no words, and so no postings. Only narrow rows are shuffled: no text and no list of a text's words, but for those of
    documents in which both rarest terms of a window stand where the window has them, and only if these are many.
    """

    def __init__(self, docs: DataFrame, benchmark: DataFrame, size: int = 10):
        self.docs = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), words(F.col("text")).alias("w"))
        self.items = materialise(windows(benchmark, size).withColumn("key", F.sha2(F.array_join("window", " "), 256)))
        only = self.items.select("key", "window").distinct()
        terms = materialise(only.select(F.explode("window").alias("term")).distinct())
        every = self.docs.select(F.explode("w").alias("term"))
        # few terms are looked up in each word's row; of many, counts of all terms are joined, made where the words are
        few = terms.count() <= SMALL_ROWS
        counts = every.join(F.broadcast(terms), "term").groupBy("term").count() if few else every.groupBy("term").count().join(terms, "term")
        counts = materialise(counts)
        # of each window, its rarest term and the next rarest one, with their first places
        ranked = only.select("key", "window", F.posexplode("window").alias("place", "term")).join(small(counts), "term", "left").withColumn("n", F.coalesce("count", F.lit(0)))
        first = ranked.groupBy("key", "window").agg(F.sort_array(F.collect_list(F.struct("n", "place", "term"))).alias("by"))
        self.plans = materialise(
            first.select(
                "key", "window", F.size("window").alias("len"), F.col("by")[0]["term"].alias("term1"), F.col("by")[0]["place"].alias("place1"),
                F.get("by", F.lit(1))["term"].alias("term2"), F.get("by", F.lit(1))["place"].alias("place2"), F.col("by")[0]["n"].alias("n1"),
            ).where("n1 > 0")
        )
        rare = materialise(self.plans.select(F.explode(F.array_compact(F.array("term1", "term2"))).alias("term")).distinct())
        self.postings = materialise(self.docs.select("doc_id", "tie", F.posexplode("w").alias("pos", "term")).join(small(rare), "term"))
        discard(terms, counts, rare)

    def _lists(self) -> tuple[DataFrame, DataFrame]:
        plans = small(self.plans)
        one = self.postings.join(plans.select("key", F.col("term1").alias("term"), "place1", "term2", "len"), "term")
        two = self.postings.join(plans.where("term2 is not null").select("key", F.col("term2").alias("term"), "place2"), "term")
        return one.select("key", "doc_id", "tie", (F.col("pos") - F.col("place1")).alias("at"), "term2", "len"), two.select("key", "doc_id", "tie", (F.col("pos") - F.col("place2")).alias("at"))

    def exact(self) -> DataFrame:
        """doc_id, tie, key, at (words before), len: each place where a window stands in a document. A written table."""
        one, two = self._lists()
        same = [one["key"] == two["key"], one["doc_id"].eqNullSafe(two["doc_id"]), one["tie"] == two["tie"], one["at"] == two["at"]]
        met = one.where("at >= 0 and term2 is null").unionByName(one.where("at >= 0 and term2 is not null").join(two, same, "left_semi"))
        met = materialise(met.select("doc_id", "tie", "key", "at", "len").distinct())
        # a document's places come to its words, which are read once, and not its words to each place
        places = materialise(met.where("len > 2").groupBy(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie")).agg(F.collect_list(F.struct("key", "at", "len")).alias("places")))
        asked = small(places)
        own = self.docs.join(asked, self.docs["doc_id"].eqNullSafe(asked["of_id"]) & (self.docs["tie"] == asked["of_tie"]))
        read = own.select("doc_id", "tie", F.explode(F.transform("places", lambda p: F.struct(p["key"].alias("key"), p["at"].alias("at"), p["len"].alias("len"), F.slice("w", p["at"] + 1, p["len"]).alias("there")))).alias("p"))
        read = read.select("doc_id", "tie", "p.key", "p.at", "p.len", "p.there").distinct()
        plans = small(self.plans)
        right = read.join(plans.select(F.col("key").alias("plan"), "window"), (F.col("key") == F.col("plan")) & (F.col("there") == F.col("window"))).select("doc_id", "tie", "key", "at", "len")
        out = materialise(met.where("len <= 2").unionByName(right))
        discard(met, places)
        return out

    def near(self, slack: int = 5) -> DataFrame:
        """doc_id, tie, key, apart: documents in which a window's two rarest terms stand at most slack words from where
        the window would have them, with the least such distance (0 with exact matches too)."""
        one, two = self._lists()
        step = slack + 1
        one = one.where("term2 is not null").select("key", "doc_id", "tie", "at", F.floor(F.col("at") / step).alias("cell"))
        two = two.select("key", "doc_id", "tie", F.col("at").alias("at2"), F.explode(F.array(*[F.floor(F.col("at") / step) + d for d in (-1, 0, 1)])).alias("cell"))
        same = [one["key"] == two["key"], one["doc_id"].eqNullSafe(two["doc_id"]), one["tie"] == two["tie"], one["cell"] == two["cell"], F.abs(one["at"] - two["at2"]) <= slack]
        return one.join(two, same).groupBy(one["doc_id"], one["tie"], one["key"]).agg(F.min(F.abs(F.col("at") - F.col("at2"))).alias("apart"))

    def discard(self) -> None:
        discard(self.items, self.plans, self.postings)


def _found(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """doc_id, tie, n_hit and items (sorted) of the documents in which some window stands. A written table."""
    index = Index(docs, benchmark, size)
    hits = index.exact()
    order = Window.partitionBy("doc_id", "tie").orderBy("at", "len").rowsBetween(Window.unboundedPreceding, -1)
    ends = hits.select("doc_id", "tie", "at", (F.col("at") + F.col("len")).alias("end"), "len").distinct().withColumn("before", F.coalesce(F.max("end").over(order), F.lit(0)))
    covered = ends.groupBy("doc_id", "tie").agg(F.sum(F.greatest(F.col("end") - F.greatest("at", "before"), F.lit(0))).alias("n_hit"))
    items = hits.select("doc_id", "tie", "key").distinct().join(index.items.select("key", "item_id"), "key").groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    both = covered.alias("c").join(items.alias("i"), F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.tie") == F.col("i.tie")))
    out = materialise(both.select(F.col("c.doc_id").alias("of_id"), F.col("c.tie").alias("of_tie"), "n_hit", "items"))
    discard(hits)
    index.discard()
    return out


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """A row for each row of docs (doc_id, text), repeated ones too: doc_id, tie (a hash of the text), n_words, n_hit (words
    inside some window's occurrence), n_items, items_sha256 (of the sorted, comma-joined item ids), contaminated.

    Null and empty texts have no words and are clean; an empty benchmark leaves all clean. Other columns are not read.
    """
    found = _found(docs, benchmark, size)
    base = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), n_words(F.col("text")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    got = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(small(found), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie")), "left").select(
        "doc_id", "tie", "n_words", n_hit.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, with their columns of whatever names, in which no window of the benchmark stands. Null and empty
    texts stay, and repeated rows stay repeated."""
    found = _found(docs, benchmark, size)
    bad = small(materialise(found.select(F.col("of_id").alias("bad_id"), F.col("of_tie").alias("bad_tie")).distinct()))
    discard(found)
    mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (mark == bad["bad_tie"]), "left_anti")
