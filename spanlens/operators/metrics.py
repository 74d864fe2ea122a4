"""Retrieval quality of full rankings against evidence spans, in one aggregate for each question and one over questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import covers_half, overlaps, resolved
from ..storage import materialise, small
from .bm25 import BM25Index
from .bm25search import Search

KS = (1, 3, 5, 10)


def first_ranks(rankings: DataFrame, questions: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """A row for each ranked question that is known: the least rank of a chunk that meets the critical span (any), covers
    half of it (half), is of the source text (source) or meets the distractor span (lure), and tokens of the first k chunks.

    questions: question_id, text_id, critical_span, distractor_span (struct with status, start, end). A chunk that is not
    known has no place in any text, and no tokens.
    """
    c = chunks.select("chunk_id", F.col("text_id").alias("c_text"), "start_char", "end_char", "n_tokens")
    q = questions.select("question_id", "text_id", "critical_span", "distractor_span")
    rows = rankings.select("question_id", "chunk_id", "rank").join(q, "question_id").join(c, "chunk_id", "left")
    aggs = [F.min(F.when(cond, F.col("rank"))).alias(name) for name, cond in _criteria().items()]
    tokens = [F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n_tokens"))), F.lit(0)).alias(f"tokens_{k}") for k in ks]
    return rows.groupBy("question_id").agg(*aggs, F.max(_known("critical_span")).alias("has_evidence"), F.max(_known("distractor_span")).alias("has_lure"), *tokens)


def _at(span: str) -> tuple:
    return F.col(f"{span}.start"), F.col(f"{span}.end")


def _known(span: str):
    return resolved(F.col(f"{span}.status"), *_at(span))


def _criteria() -> dict:
    """Of a row with a question's columns and a chunk's c_text, start_char and end_char."""
    same, cs, ce = F.col("c_text") == F.col("text_id"), F.col("start_char"), F.col("end_char")
    meets = _known("critical_span") & same & overlaps(cs, ce, *_at("critical_span"))
    return {"any": meets, "half": meets & covers_half(cs, ce, *_at("critical_span")), "source": same, "lure": _known("distractor_span") & same & overlaps(cs, ce, *_at("distractor_span"))}


def first_ranks_of_scores(index: BM25Index, queries: DataFrame, questions: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """What first_ranks gives for the full ranking of index for queries, without making that ranking.

    The first chunk of each kind is the one of the question's text with the best score; its rank is one more than the
    number of chunks that go before it, which is a count. Only the first max(ks) chunks are ranked. A question whose
    first chunk shares no term with it is ranked in full, unless the queries fit in memory: then chunks at score 0 are
    counted like others, and no score is written but those of the questions' own texts.
    """
    search = index.search(queries)
    if search:
        return _first_ranks_of_search(index, search, queries, questions, chunks, ks)
    scored = materialise(index.score(queries).select("query_id", "doc_id", F.col("score"), F.round("score", 9).alias("s")))
    q = questions.select("question_id", "text_id", "critical_span", "distractor_span")
    c = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("text_id").alias("c_text"), "start_char", "end_char")
    own = q.join(c, F.col("c_text") == F.col("text_id")).join(scored.select(F.col("query_id").alias("question_id"), "doc_id", "s"), ["question_id", "doc_id"], "left")
    place = F.struct((-F.coalesce("s", F.lit(0.0))).alias("s"), F.col("doc_id"))
    kinds = _criteria()
    best = materialise(own.groupBy("question_id").agg(*[F.min(F.when(cond, place)).alias(name) for name, cond in kinds.items()]))
    asked = q.join(queries.select(F.col("query_id").alias("question_id")), "question_id").join(best, "question_id", "left")
    ahead = {name: (F.struct((-F.col("s")).alias("s"), F.col("doc_id")) < F.col(name)) for name in kinds}
    counts = scored.join(small(best), F.col("query_id") == F.col("question_id")).groupBy("question_id").agg(*[F.count_if(cond).alias(f"n_{name}") for name, cond in ahead.items()])
    top = index.rank(queries, max(ks), scored=scored.select("query_id", F.lit("*").alias("scope"), "doc_id", "score"))
    sums = top.join(chunks.select(F.col("chunk_id").alias("doc_id"), "n_tokens"), "doc_id", "left").groupBy(F.col("query_id").alias("question_id"))
    tokens = sums.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n_tokens"))), F.lit(0)).alias(f"tokens_{k}") for k in ks])
    far = F.greatest(*[F.coalesce(F.col(f"{name}.s"), F.lit(-1.0)) for name in kinds]) >= 0
    per = asked.withColumn("far", far).join(counts, "question_id", "left").join(tokens, "question_id")
    ranks = [F.when(F.col(name).isNotNull(), F.coalesce(f"n_{name}", F.lit(0)) + 1).alias(name) for name in kinds]
    flags = [_known("critical_span").alias("has_evidence"), _known("distractor_span").alias("has_lure")]
    near = per.where("not far").select("question_id", *ranks, *flags, *[f"tokens_{k}" for k in ks])
    rest = materialise(per.where("far").select(F.col("question_id").alias("query_id")))
    if rest.isEmpty():
        return near
    ranked = index.rank(queries.join(rest, "query_id", "left_semi")).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "rank")
    return near.unionByName(first_ranks(ranked, questions, chunks, ks))


def _own(scored: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id and for each kind the place (-s, doc_id) of the first chunk of the question's text, from scores s."""
    c = chunks.select(F.col("chunk_id").alias("doc_id"), F.col("text_id").alias("c_text"), "start_char", "end_char")
    own = questions.join(c, F.col("c_text") == F.col("text_id")).join(scored.select(F.col("query_id").alias("question_id"), "doc_id", "s"), ["question_id", "doc_id"], "left")
    place = F.struct((-F.coalesce("s", F.lit(0.0))).alias("s"), F.col("doc_id"))
    return own.groupBy("question_id").agg(*[F.min(F.when(cond, place)).alias(name) for name, cond in _criteria().items()])


def _first_ranks_of_search(index: BM25Index, search: Search, queries: DataFrame, questions: DataFrame, chunks: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    kinds = list(_criteria())
    q = small(materialise(questions.select("question_id", "text_id", "critical_span", "distractor_span")))
    ids = small(materialise(chunks.join(q.select("text_id").distinct(), "text_id", "left_semi").select(F.col("chunk_id").alias("doc_id")).distinct()))
    scored = materialise(search.scores(search.table.join(ids, "doc_id", "left_semi")).select("query_id", "doc_id", F.round("score", 9).alias("s")))
    own = chunks.join(q.select("text_id").distinct(), "text_id", "left_semi")
    places = {r["question_id"]: [None if r[n] is None else (-r[n]["s"], r[n]["doc_id"]) for n in kinds] for r in _own(scored, q, own).collect()}
    top = index.rank(queries, max(ks))
    sums = top.join(chunks.select(F.col("chunk_id").alias("doc_id"), "n_tokens"), "doc_id", "left").groupBy(F.col("query_id").alias("question_id"))
    tokens = sums.agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("n_tokens"))), F.lit(0)).alias(f"tokens_{k}") for k in ks])
    ahead = search.ahead(places, kinds).withColumnRenamed("query_id", "question_id")
    per = q.join(queries.select(F.col("query_id").alias("question_id")), "question_id").join(ahead, "question_id", "left").join(tokens, "question_id")
    flags = [_known("critical_span").alias("has_evidence"), _known("distractor_span").alias("has_lure")]
    return per.select("question_id", *[(F.col(n) + 1).alias(n) for n in kinds], *flags, *[f"tokens_{k}" for k in ks])


def recall(rank: str, k: int, among: str | None = None):
    hit = F.coalesce((F.col(rank) <= k).cast("double"), F.lit(0.0))
    return F.avg(hit if among is None else F.when(F.col(among), hit))


def mrr(rank: str, among: str | None = None):
    value = F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0))
    return F.avg(value if among is None else F.when(F.col(among), value))


def compute_metrics(rankings: DataFrame, questions: DataFrame, chunks: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Tidy rows metric, criterion, k, value (rounded to 6 places), n."""
    return tidy(first_ranks(rankings, questions, chunks, ks), ks)


def tidy(per: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """The metrics of first_ranks()."""
    rows: list[tuple] = []
    for name, rank, among, criterion in (("evidence_recall", "any", "has_evidence", "any"), ("evidence_recall", "half", "has_evidence", "cov50"), ("source_recall", "source", None, "text"), ("distractor_rate", "lure", "has_lure", "any")):
        n = F.count("*") if among is None else F.count_if(F.col(among))
        rows += [(name, criterion, k, recall(rank, k, among), n) for k in ks]
        if name != "distractor_rate":
            rows.append((name.replace("recall", "mrr"), criterion, None, mrr(rank, among), n))
    for k in ks:
        for stat, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max)):
            rows.append(("context_tokens", stat, k, f(F.col(f"tokens_{k}")).cast("double"), F.count("*")))
    one = per.agg(*[f.alias(f"v{i}") for i, (*_, f, _) in enumerate(rows)], *[n.alias(f"n{i}") for i, (*_, n) in enumerate(rows)])
    lines = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(c).alias("criterion"), F.lit(k).cast("int").alias("k"), F.round(F.col(f"v{i}"), 6).alias("value"), F.col(f"n{i}").alias("n")) for i, (m, c, k, *_) in enumerate(rows)])
    return one.select(F.inline(lines))


def skipped(rankings: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id and reasons (sorted, of missing_question, no_evidence, no_distractor) of ranked questions that some metric
    leaves out, each once."""
    ids = rankings.select("question_id").distinct()
    q = questions.select("question_id", F.lit(True).alias("here"), _known("critical_span").alias("e"), _known("distractor_span").alias("d"))
    why = {"missing_question": F.col("here").isNull(), "no_evidence": F.col("here") & ~F.col("e"), "no_distractor": F.col("here") & ~F.col("d")}
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in why.items()])))
    return ids.join(q, "question_id", "left").select("question_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def skip_counts(rankings: DataFrame, questions: DataFrame) -> DataFrame:
    """missing_question, no_evidence, no_distractor among ranked questions."""
    return skipped(rankings, questions).agg(*[F.count_if(F.array_contains("reasons", r)).alias(r) for r in ("missing_question", "no_evidence", "no_distractor")])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
