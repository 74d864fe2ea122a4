import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.operators import align, chunk, dense, fuse, metrics, sample, search
from spanlens.operators.bm25 import BM25Index

BODY = "Den éischte Saz. Den zweeten Saz ass hei!\n\nEng Linn-\ntrennung steet hei.\nDen zweeten Saz ass hei!\n"


def spans_of(spark, body, strategy, **how):
    rows = chunk.chunk(spark.createDataFrame([("text1", body)], "text_id string, body string"), strategy, **how).orderBy("idx").collect()
    assert all(body[r.start_char : r.end_char] == r.chunk_text and r.chunk_id == f"text1_{strategy}_c{r.idx:03d}" for r in rows)
    return [(r.start_char, r.end_char, r.n_tokens) for r in rows]


def test_overlap_chunks(spark):
    body = "  " + " ".join(f"w{i}" for i in range(520)) + "\n"
    got = spans_of(spark, body, "overlap")
    assert len(got) == 6 and got[0][0] == 0 and got[-1][1] == len(body)
    assert [n for *_, n in got] == [150] * 5 + [145]
    assert spans_of(spark, " \n", "overlap") == []
    assert len(spans_of(spark, "a b c", "overlap", window=2, overlap=0.5)) == 2


def test_sentences(spark):
    got = [BODY[a:b] for a, b, _ in spans_of(spark, BODY, "sentence")]
    assert got == ["Den éischte Saz.", "Den zweeten Saz ass hei!", "Eng Linn-\ntrennung steet hei.", "Den zweeten Saz ass hei!"]
    s = "Hie sot: «Jo!» An du? 1000.5 … 3.Dann"
    assert [s[a:b] for a, b, _ in spans_of(spark, s, "sentence")] == ["Hie sot: «Jo!»", "An du?", "1000.5 …", "3.Dann"]


def fold(body):
    """Line groups by a plain loop."""
    out, opened, held, at = [], None, 0, 0
    for line in body.split("\n"):
        if line.strip():
            opened = at if opened is None else opened
            held += len(line.split())
            if (re.search("[.!?…]['\"”»)]*$", line.rstrip()) and held >= 60) or held >= 180:
                out.append((opened, at + len(line)))
                opened, held = None, 0
        at += len(line) + 1
    if opened is not None:
        out.append((opened, len(body)))
    return [(a + len(body[a:b]) - len(body[a:b].lstrip()), a + len(body[a:b].rstrip())) for a, b in out]


def test_paragraphs(spark):
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(10)) + ("." if i % 4 == 3 else "") for i in range(43))
    assert [(a, b) for a, b, _ in spans_of(spark, long, "paragraph")] == fold(long)
    free = "\n".join("a b c d e f g h i j" for _ in range(40))
    assert [n for *_, n in spans_of(spark, free, "paragraph")] == [180, 180, 40]
    assert [n for *_, n in spans_of(spark, "kuerz\n \n\nzwee Wierder", "paragraph")] == [1, 2]
    with pytest.raises(ValueError):
        chunk.chunk(spark.createDataFrame([("t", "x")], "text_id string, body string"), "none")


def test_coverage(spark):
    texts = spark.createDataFrame([("a", "x" * 10), ("b", "y" * 10), ("c", ""), ("d", "z")], "text_id string, body string")
    chunks = spark.createDataFrame([("a", 0, 6), ("a", 5, 10), ("b", 0, 4), ("b", 5, 9)], "text_id string, start_char int, end_char int")
    assert {r.text_id: r.gaps for r in chunk.coverage(chunks, texts).collect()} == {"a": 0, "b": 2, "c": 0, "d": 1}


def locate(raw, body=BODY, title="Den Titel", author="E Schreiwer", **how):
    return align.locate_span(raw, body, title, author, **how)


def test_alignment_cascade():
    s = locate("Den éischte  Saz.")
    assert (s.status, BODY[s.start : s.end]) == ("exact", "Den éischte Saz.")
    s = locate("Eng Linntrennung steet <LEX-A>hei")
    assert (s.status, BODY[s.start : s.end]) == ("dehyphen", "Eng Linn-\ntrennung steet hei")
    s = locate("Den zweeten Saz ass hei!")
    assert (s.status, s.n_matches, s.start) == ("multiple", 2, 17)
    s = locate("Den Titel")
    assert (s.status, s.in_title, s.start) == ("exact", True, None)
    s = locate("Den Titel E Schreiwer. Eng Linn-trennung")
    assert (s.status, BODY[s.start : s.end]) == ("exact", "Eng Linn-\ntrennung")
    s = locate("Eng Linntrenung steed hei.")
    assert s.status == "fuzzy" and s.ratio >= 0.85 and not s.partial
    assert locate("").status == locate(" <LEX-A> ").status == locate(None).status == "empty"
    assert locate("komplett aner Wierder ouni Bezuch").status == "unresolved"


def test_alignment_partial_and_thresholds():
    body = "Ufank vum Text. " + "Dëst ass e laange Saz mat villen Wierder dran. " + "Nach eppes. Zum Schluss kënnt nach e laangen Enn mat Wierder."
    s = align.locate_span("Dëst ass e laange Saz mat villen Wierder dran. Qqqq wwww rrrr tttt zzzz pppp ssss ffff gggg jjjj llll xxxx vvvv nnnn.", body)
    assert s.partial and s.status == "fuzzy" and body[s.start : s.end] == "Dëst ass e laange Saz mat villen Wierder dran."
    assert align.sentence_pieces("Aaa.Bbb ccc. ddd […] Eee – fff") == ["Aaa.", "Bbb ccc.", "ddd", "[…]", "Eee", "–", "fff"]


def test_alignment_of_rows(spark):
    rows = [(1, "Den éischte Saz.", BODY, "Den Titel", None), (2, "Eng Linntrenung steed hei.", BODY, None, None), (3, None, BODY, None, None), (4, "x", None, None, None), (5, "Den zweeten Saz ass hei!", BODY, None, None)]
    got = {r.id: r.span for r in align.align(spark.createDataFrame(rows, "id int, raw string, body string, title string, author string")).collect()}
    for i, raw, body, title, author in rows:
        assert tuple(got[i]) == tuple(vars(align.locate_span(raw, body, title, author)).values()), i


def test_locate_exact(spark):
    df = spark.createDataFrame([("zweeten\nSaz", BODY), ("nët do", BODY), ("", BODY), ("é 😀b", "a é😀 b"), ("a.b", "xaxb a . b")], "s string, b string")
    got = [tuple(r.g) for r in df.select(align.locate_exact(F.col("s"), F.col("b")).alias("g")).collect()]
    assert got == [(21, 32, 2), (None, None, 0), (None, None, 0), (2, 6, 1), (5, 10, 1)]


DOCS = {"a": "x y x", "b": "y z", "c": "", "d": "w w w w"}


def brute_bm25(docs, query):
    toks = {k: v.split() for k, v in docs.items()}
    avg, n = sum(map(len, toks.values())) / len(toks), len(toks)
    out = {}
    for k, t in toks.items():
        s = 0.0
        for q in query.split():
            df = sum(q in x for x in toks.values())
            if df and q in t:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out[k] = s
    return out


def frame(spark, docs, scope="*"):
    return spark.createDataFrame([(scope, k, v.split()) for k, v in docs.items()], "scope string, doc_id string, tokens array<string>")


def asked(spark, *queries):
    return spark.createDataFrame([(i, "*", q.split()) for i, q in enumerate(queries)], "query_id int, scope string, tokens array<string>")


def test_bm25(spark):
    rows = BM25Index(frame(spark, DOCS)).rank(asked(spark, "x y y", "nothing")).collect()
    want = brute_bm25(DOCS, "x y y")
    assert {r.doc_id: r.score for r in rows if r.query_id == 0} == pytest.approx(want)
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 0] == sorted(want, key=lambda k: (-round(want[k], 9), k))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == 1] == list("abcd")
    top = BM25Index(frame(spark, DOCS)).rank(asked(spark, "x y"), k=1).collect()
    assert [(r.doc_id, r["rank"]) for r in top] == [("a", 1)]
    with pytest.raises(ValueError):
        BM25Index(frame(spark, DOCS)).rank(asked(spark, "x"), k=0)


def test_bm25_top_is_the_head_of_the_full_ranking(spark):
    both = frame(spark, DOCS, "one").union(frame(spark, {"e": "x", "f": "q q"}, "two"))
    rows = [(1, "one", ["w"]), (2, "one", ["nothing"]), (3, "one", []), (4, "two", ["q"]), (5, "one", ["x", "y"]), (6, "two", ["w"])]
    q = spark.createDataFrame(rows, "query_id int, scope string, tokens array<string>")
    index = BM25Index(both)
    full = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in index.rank(q).collect())
    for k in (1, 2, 3, 9):
        assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in index.rank(q, k=k).collect()) == [r for r in full if r[1] <= k]


def test_bm25_scopes_have_their_own_statistics(spark):
    both = frame(spark, DOCS, "one").union(frame(spark, {"e": "x", "f": "q q"}, "two"))
    q = spark.createDataFrame([(1, "two", ["x"])], "query_id int, scope string, tokens array<string>")
    assert {r.doc_id: r.score for r in BM25Index(both).rank(q).collect()} == pytest.approx(brute_bm25({"e": "x", "f": "q q"}, "x"))


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, doc_id string, score double, rank int")


def test_fusion(spark):
    a = ranking(spark, [(1, "a", 9.0, 1), (1, "b", 5.0, 2), (1, "c", 1.0, 3)])
    b = ranking(spark, [(1, "c", 0.9, 1), (1, "d", 0.8, 2), (1, "a", 0.1, 3)])
    got = {r.doc_id: (r.score, r["rank"]) for r in fuse.reciprocal_rank_fusion(a, b).collect()}
    assert got["a"] == (pytest.approx(1 / 61 + 1 / 63), 1) and got["c"] == (pytest.approx(1 / 63 + 1 / 61), 2) and got["b"][1] == 3 and got["d"][1] == 4
    got = {r.doc_id: r.score for r in fuse.weighted_minmax_fusion(a, b, 0.5).collect()}
    assert got == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.5, "d": 0.4375})
    flat = ranking(spark, [(1, "a", 2.0, 1), (1, "b", 2.0, 2)])
    assert {r.score for r in fuse.weighted_minmax_fusion(flat, flat, 1.0).collect()} == {0.0}
    with pytest.raises(ValueError):
        fuse.weighted_minmax_fusion(a, b, 1.5)


def test_dense(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0], "t"), ("b", [0.0, 2.0], "t"), ("c", [3.0, 3.0], "u"), ("z", [0.0, 0.0], "u")], "doc_id string, embedding array<double>, text_id string")
    q = spark.createDataFrame([(1, [1.0, 1.0], "t")], "query_id int, embedding array<double>, text_id string")
    assert [(r.doc_id, round(r.score, 6)) for r in dense.DenseIndex(docs).rank(q).orderBy("rank").collect()] == [("c", 1.0), ("a", 0.707107), ("b", 0.707107), ("z", 0.0)]
    assert [r.doc_id for r in dense.DenseIndex(docs).rank(q, restricted=True).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(RuntimeError):
        dense.DenseIndex(None).rank(q)
    texts = spark.createDataFrame([(1, "aa"), (2, None)], "id int, t string")
    got = {r.id: r.embedding for r in dense.embed(texts, "id", "t", lambda ts: np.array([[len(t), 4.0] for t in ts]), "p:").collect()}
    assert got[1] == pytest.approx([4 / math.sqrt(32)] * 2) and got[2] == pytest.approx([2 / math.sqrt(20), 4 / math.sqrt(20)])
    assert dense.cache_key("m", "p", ["1"], ["x"]) != dense.cache_key("m", "q", ["1"], ["x"])


def test_search_settings(spark):
    chunks = spark.createDataFrame([("text1_p_c000", "text1", "Hond a Kaz"), ("text1_p_c001", "text1", "Haus"), ("text2_p_c000", "text2", "Hond Hond")], "chunk_id string, text_id string, chunk_text string")
    qs = spark.createDataFrame([("text1_q01", "text1", "Hond?", {"A": "a", "B": "b", "C": "c", "D": "Haus"})], "question_id string, text_id string, question string, presented map<string,string>")
    got = search.run_search(qs, chunks, "bm25", "open_corpus").orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["text2_p_c000", "text1_p_c000", "text1_p_c001"] and got[0].method == "bm25"
    got = search.run_search(qs, chunks, "bm25", "text_restricted", "question_options", "char_ngram").orderBy("rank").collect()
    assert {r.chunk_id[:5] for r in got} == {"text1"} and got[0].method == "bm25_char" and all(r.score > 0 for r in got)
    for bad in (("dense", "open_corpus"), ("nope", "open_corpus"), ("bm25", "nope")):
        with pytest.raises(ValueError):
            search.run_search(qs, chunks, *bad)


def test_metrics_geometry(spark):
    chunks = spark.createDataFrame([("t1_c_c0", "t1", 0, 10, 3), ("t1_c_c1", "t1", 15, 30, 4), ("t1_c_c2", "t1", 18, 40, 5), ("t2_c_c0", "t2", 10, 20, 6)], "chunk_id string, text_id string, start_char int, end_char int, n_tokens int")
    span = "struct<status:string,start:int,end:int>"
    qs = spark.createDataFrame([("q1", "t1", ("exact", 10, 20), ("exact", 35, 50)), ("q2", "t1", ("unresolved", None, None), ("empty", None, None))], f"question_id string, text_id string, critical_span {span}, distractor_span {span}")
    order = ["t2_c_c0", "t1_c_c0", "t1_c_c2", "t1_c_c1"]
    ranks = spark.createDataFrame([(q, c, i + 1) for q in ("q1", "q2", "q9") for i, c in enumerate(order)], "question_id string, chunk_id string, rank int")
    got = {(r.metric, r.criterion, r.k): (r.value, r.n) for r in metrics.compute_metrics(ranks, qs, chunks).collect()}
    assert got["evidence_recall", "any", 1] == (0.0, 1) and got["evidence_recall", "any", 3] == (1.0, 1)
    assert got["evidence_recall", "cov50", 3] == (0.0, 1) and got["evidence_recall", "cov50", 5] == (1.0, 1)
    assert got["evidence_mrr", "any", None] == (round(1 / 3, 6), 1) and got["evidence_mrr", "cov50", None] == (0.25, 1)
    assert got["source_recall", "text", 1] == (0.0, 2) and got["source_mrr", "text", None] == (0.5, 2)
    assert got["distractor_rate", "any", 3] == (1.0, 1)
    assert got["context_tokens", "mean", 1] == (6.0, 2) and got["context_tokens", "max", 10] == (18.0, 2)
    assert tuple(metrics.skip_counts(ranks, qs).first()) == (1, 1, 1)


def test_samples(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(30)], "s int, id int")
    got = sample.stratified_sample(df, "s", "id", 4)
    assert sorted(r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()) == [4, 4, 4]
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in sample.stratified_sample(df.repartition(5), "s", "id", 4).collect())
    import random

    rng = random.Random(13)
    want = [x for s in range(3) for x in sorted(rng.sample([i for i in range(30) if i % 3 == s], 2))]
    assert sorted(r.id for r in sample.seeded_sample(df, "s", "id", 2).collect()) == sorted(want)


def test_seeded_sample_orders_texts_by_number(spark):
    import random

    rng, ids = random.Random(13), {f"text{s}": [f"text{s}_q{i}" for i in range(6)] for s in range(1, 12)}
    want = [x for s in range(1, 12) for x in rng.sample(ids[f"text{s}"], 2)]
    df = spark.createDataFrame([(s, x) for s, xs in ids.items() for x in xs], "text_id string, question_id string").repartition(4)
    assert sorted(r.question_id for r in sample.seeded_sample(df, "text_id", "question_id", 2).collect()) == sorted(want)


def test_alignment_counts(spark):
    S = f"struct<{align.SPAN.replace(' ', ':').replace(',:', ',')}>"
    span = lambda status, partial=False: (None, None, status, False, None, None, partial)
    rows = [("text1", "Retrieve", span("exact"), span("fuzzy", True)), ("text1", "Interpret", span("fuzzy", True), span("empty")), ("text2", "Retrieve", span("fuzzy"), span("unresolved"))]
    got = {(r.kind, r.span, r.value): r.n for r in align.counts(spark.createDataFrame(rows, f"text_id string, cognitive_type string, critical_span {S}, distractor_span {S}")).collect()}
    assert got == {
        ("status", "critical", "exact"): 1, ("status", "critical", "fuzzy"): 2, ("status", "distractor", "fuzzy"): 1, ("status", "distractor", "empty"): 1, ("status", "distractor", "unresolved"): 1,
        ("located", "critical", None): 3, ("located", "distractor", None): 1, ("partial", "critical", None): 1, ("partial", "distractor", None): 1,
        ("text_id", None, "text1"): 2, ("text_id", None, "text2"): 1, ("cognitive_type", None, "Retrieve"): 2, ("cognitive_type", None, "Interpret"): 1,
    }


def test_alignment_counts_query(spark, tmp_path):
    from spanlens.plans.retrieval import QUERIES

    body = "Den éischte Saz steet hei. Den zweeten Saz ass och do, an en ass méi laang."
    spark.createDataFrame([(1, body, "lb", "s", len(body))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, "Den zweeten Saz ass och do"), (5, "Saz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.kind, r.span, r.value): r.n for r in QUERIES["alignment_counts"](spark, str(tmp_path)).collect()}
    assert got["status", "distractor", "exact"] == got["status", "distractor", "multiple"] == 1 and got["text_id", None, "1"] == 2
    assert sum(n for (kind, span, _), n in got.items() if (kind, span) == ("status", "critical")) == 2
