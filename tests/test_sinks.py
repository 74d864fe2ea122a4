import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens import report
from spanlens.functions.text import find_all, fold, normalize, pieces_between, running
from spanlens.operators import analysis, chunk, clients, dense, metrics, search
from spanlens.operators.bm25 import BM25Index
from spanlens.sources import readers
from spanlens.sources.contracts import SchemaError
from spanlens.storage import discard, materialise


def test_parameters_that_a_service_refuses_are_changed_once():
    sent = []

    def send(request):
        sent.append(request)
        if "max_tokens" in request:
            raise RuntimeError("400: use max_completion_tokens instead of max_tokens")
        if "temperature" in request:
            raise RuntimeError("400: temperature: only the default (1) is allowed")
        return "B"

    client = clients.make_client("openai", "m", send, max_tokens=9)
    assert client.complete("q") == "B" and client.complete("r") == "B" and len(sent) == 4
    assert sent[-1] == {"model": "m", "messages": [{"role": "user", "content": "r"}], "max_completion_tokens": 9}
    about = client.describe()
    assert (about["temperature"], about["requested_temperature"], about["token_param"], about["api_key_env"]) == (None, 0.0, "max_completion_tokens", "OPENAI_API_KEY")


def test_other_errors_are_raised_at_once():
    calls = []

    def send(request):
        calls.append(1)
        raise RuntimeError("temperature is deprecated" if "temperature" in request else "overloaded")

    client = clients.make_client("anthropic", "m", send)
    with pytest.raises(RuntimeError, match="overloaded"):
        client.complete("q")
    assert len(calls) == 2 and clients.make_client("mock", "m", output="D").complete("q") == "D"
    for bad in ("other", "openai"):
        with pytest.raises(ValueError):
            clients.make_client(bad, "m")


def test_data_root(tmp_path, monkeypatch):
    monkeypatch.delenv(readers.ROOT_VARIABLE, raising=False)
    monkeypatch.chdir(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.find_data_root()
    for name in ("a/dataset", "b", "dataset/dataset"):
        (tmp_path / name / readers.TEXTS).mkdir(parents=True)
        (tmp_path / name / readers.COLLECTION).write_text("")
    assert readers.find_data_root() == str(tmp_path / "dataset/dataset")
    monkeypatch.setenv(readers.ROOT_VARIABLE, str(tmp_path / "b"))
    assert readers.find_data_root() == str(tmp_path / "b")
    assert readers.find_data_root(str(tmp_path / "a")) == str(tmp_path / "a/dataset")


def test_errors_of_json_lines_have_file_and_line(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n[1]\n"x"\n')
    assert [r.a for r in readers.read_objects(spark, f"{tmp_path}/good.jsonl", "a int").orderBy("a").collect()] == [1, 2]
    got = readers.jsonl_errors(spark, f"{tmp_path}/*.jsonl").orderBy("line").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line, r.message) for r in got] == [("bad.jsonl", 3, "malformed JSON"), ("bad.jsonl", 4, "not an object"), ("bad.jsonl", 5, "not an object")]
    with pytest.raises(SchemaError, match="bad.jsonl:3"):
        readers.read_objects(spark, f"{tmp_path}/bad.jsonl", "a int")


def test_runs_need_sidecars(spark, tmp_path):
    for name, side in (("one", "{}"), ("two", None), ("three", "[1]")):
        (tmp_path / f"preds_{name}.jsonl").write_text('{"question_id": "text1_q01"}\n')
        if side is not None:
            (tmp_path / f"preds_{name}.config.json").write_text(side)
    got = {(r.key, r.message) for r in readers.sidecar_violations(spark, str(tmp_path)).collect()}
    assert got == {("two", "no sidecar"), ("three", "sidecar is no object")}


def test_last_row_of_an_id_wins(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "id int, text string, line int")
    assert sorted(map(tuple, readers.last_by_id(df, "id", ["line"]).collect())) == [(1, "c", 2), (2, "b", 1)]


CHUNKS = [("text1_overlap_c000", "text1", "a red fox runs", 0, 14), ("text1_overlap_c001", "text1", "the lazy dog", 10, 22), ("text2_overlap_c000", "text2", "red red wine", 0, 12)]


def test_run_and_write(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text_id string, chunk_text string, start_char int, end_char int")
    q = spark.createDataFrame([("text1_q01", "text1", "red fox"), ("text2_q01", "text2", "nothing known")], "question_id string, text_id string, question string")
    path = search.run_and_write(q, chunks, "bm25", "open_corpus", str(tmp_path))
    assert path.endswith("rankings_open_corpus_bm25_overlap_question_only.jsonl")
    back = {r.question_id: [x.chunk_id for x in r.ranking] for r in spark.read.json(path).collect()}
    assert back == {"text1_q01": [CHUNKS[0][0], CHUNKS[2][0], CHUNKS[1][0]], "text2_q01": [c[0] for c in CHUNKS]}
    with pytest.raises(ValueError):
        search.run_and_write(q, chunks.withColumn("chunk_id", F.concat(F.lit("x_"), F.monotonically_increasing_id().cast("string"), F.lit("_c1"))), "bm25", "open_corpus", str(tmp_path))


def test_embeddings_are_kept_by_content(spark, tmp_path):
    made = tmp_path / "made"
    made.mkdir()

    def embedder(texts):
        for t in texts:
            (made / f"{abs(hash(t))}").write_text(t)
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, None)], "id int, text string")
    first = dense.cached_embeddings(df, "id", "text", embedder, "m", str(tmp_path / "c"), "p: ")
    assert first.count() == 3 and len(list(made.iterdir())) == 3
    for f in made.iterdir():
        f.unlink()
    again = dense.cached_embeddings(df.orderBy(F.desc("id")), "id", "text", embedder, "m", str(tmp_path / "c"), "p: ")
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect())) and not list(made.iterdir())
    keys = {dense.content_key(d, "id", "text", m, p) for d, m, p in ((df, "m", "p"), (df, "m2", "p"), (df, "m", "q"), (df.where("id > 1"), "m", "p"), (df.withColumn("text", F.lit("x")), "m", "p"))}
    assert len(keys) == 5


def test_bootstrap_of_counts_agrees_with_that_of_rows(spark):
    df = spark.range(400).select(F.col("id").alias("question_id"), F.lit("c").alias("g"), (F.col("id") % 4 == 0).alias("is_correct"))
    rows, counts = (f(df, ["g"], 4000).first() for f in (analysis.with_bootstrap, analysis.with_bootstrap_of_counts))
    assert (rows.n, rows.accuracy) == (counts.n, counts.accuracy) == (400, 0.25)
    assert counts.ci_low == pytest.approx(rows.ci_low, abs=0.01) and counts.ci_high == pytest.approx(rows.ci_high, abs=0.01)


def test_human_evaluation_and_alignment_reports(spark, tmp_path):
    span = "struct<start:int,end:int,status:string>"
    q = spark.createDataFrame(
        [("text1_q01", "text1", "T", "Retrieve", "who?", {"A": "x", "B": "y", "C": "z", "D": "w"}, ["correct", "misunderstand", "distractor_span", "no_support"], "A", "a red fox runs by", (2, 9, "exact"), (None, None, "empty"))],
        f"question_id string, text_id string, text_title string, cognitive_type string, question string, presented map<string,string>, permutation array<string>, gold_letter string, body string, critical_span {span}, distractor_span {span}",
    )
    answers = spark.createDataFrame([("text1_q01", m, letter, kind, ok, ["text1_overlap_c000", "text1_overlap_c001"]) for m, letter, kind, ok in (("m1", "A", "correct", True), ("m2", "B", "misunderstand", False))], "question_id string, model string, parsed_letter string, semantic_choice string, is_correct boolean, context_chunk_ids array<string>")
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, text_id string, chunk_text string, start_char int, end_char int")
    rows = report.human_eval(q, answers, chunks)
    md = report.write_human_eval(rows, str(tmp_path), "t").read_text()
    assert "- A. x _[correct]_ **(gold)**" in md and "**Critical span** (retrieved: yes): red fox" in md and "- m2: B (misunderstand), wrong" in md
    line = json.loads(next(p for p in (tmp_path / "human_eval_t.jsonl").glob("part-*.json") if p.read_text()).read_text())
    assert line["model_answers"]["m1"] == {"letter": "A", "semantic": "correct", "correct": True} and [c["rank"] for c in line["retrieved_chunks"]] == [1, 2] and not line["distractor_retrieved"]
    counts = spark.createDataFrame([("status", "critical", "exact", 1), ("located", "critical", None, 1), ("partial", "critical", None, 0), ("text_id", None, "text1", 1), ("cognitive_type", None, "Retrieve", 1)], "kind string, span string, value string, n long")
    assert "| overlap | text1 | 2 |" in report.alignment_report(counts, spark.createDataFrame([("overlap", "text1", 2)], "strategy string, text_id string, n long"))


def test_folds_carry_state_over_blocks(spark):
    n = 1000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7).alias("x"))
    got = df.select(running(F.col("x")).alias("r"), fold(F.col("x"), {"s": F.lit(0)}, "int", lambda a, x: ({"s": a["s"] + x}, F.when(x == 0, F.array(a["s"])).otherwise(F.array().cast("array<int>"))), block=9)["out"].alias("o")).first()
    xs = [i % 7 for i in range(1, n + 1)]
    assert got.r == [sum(xs[:i]) for i in range(n)] and got.o == [sum(xs[:i]) for i in range(n) if xs[i] == 0]


def test_long_texts_are_chunked_in_linear_time(spark):
    body = "é😀 one two. Three four!\n" * 40_000  # 1 MB
    df = spark.createDataFrame([(1, body)], "text_id long, body string")
    for strategy in ("sentence", "overlap", "paragraph"):
        rows = chunk.chunk(df, strategy).collect()
        assert all(body[r.start_char : r.end_char] == r.chunk_text for r in rows[:: max(1, len(rows) // 50)]), strategy
    hits = df.select(find_all(F.lit("two"), F.col("body")).alias("h")).first().h
    assert len(hits) == 40_000 and hits[-1] == body.rindex("two")
    starts, ends = [0, 5, 900_000], [0, 5000, 900_010]
    got = df.select(pieces_between(F.col("body"), F.array(*map(F.lit, starts)), F.array(*map(F.lit, ends))).alias("p")).first().p
    assert got == [body[a:b] for a, b in zip(starts, ends, strict=True)]


def test_normal_form_joins_marks(spark):
    rows = ["Café", "ạ̇", "한", "Å", "plain – ‘x’", "①ﬁ", None]
    import unicodedata

    got = [r[0] for r in spark.createDataFrame([(s,) for s in rows], "s string").select(normalize(F.col("s"))).collect()]
    assert got == [None if s is None else unicodedata.normalize("NFC", s).replace("’", "'").lower() for s in rows]


def test_counted_ranks_are_those_of_the_full_ranking(spark):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"text{i % 6}_c{i:03d}", f"text{i % 6}", (i // 6) * 10, (i // 6) * 10 + 15, 5, [rng.choice(words) for _ in range(8)]) for i in range(60)]
    chunks = spark.createDataFrame(docs, "chunk_id string, text_id string, start_char int, end_char int, n_tokens int, tokens array<string>")
    span = "struct<status:string,start:int,end:int>"
    qs = [(f"q{i}", f"text{i % 6}", ("exact", 20, 32) if i % 3 else ("unresolved", None, None), ("exact", 5, 9), [rng.choice(words) for _ in range(3)] if i else ["unknown"]) for i in range(12)]
    q = spark.createDataFrame(qs, f"question_id string, text_id string, critical_span {span}, distractor_span {span}, tokens array<string>")
    index = BM25Index(chunks.select(F.lit("*").alias("scope"), F.col("chunk_id").alias("doc_id"), "tokens"))
    asked = q.select(F.col("question_id").alias("query_id"), F.lit("*").alias("scope"), "tokens")
    ranked = index.rank(asked).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("chunk_id"), "rank")
    full, counted = (sorted(map(tuple, df.select("question_id", "any", "half", "source", "lure", "has_evidence", "has_lure", "tokens_1", "tokens_10").collect()), key=str) for df in (metrics.first_ranks(ranked, q, chunks), metrics.first_ranks_of_scores(index, asked, q, chunks)))
    assert counted == full


def test_n_grams_of_words_are_those_of_places(spark):
    from spanlens.functions.text import char_ngram_tokenize, word_tokenize

    texts = spark.createDataFrame([(1, "the cat sat on the catalogue"), (2, "a catalogue of cats"), (3, ""), (4, "of of of")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "cats of"), (2, "zzz")], "query_id int, text string").select("query_id", F.lit("*").alias("scope"), char_ngram_tokenize(F.col("text")).alias("tokens"))
    one, two = (BM25Index(texts.select(F.lit("*").alias("scope"), "doc_id", t(F.col("text")).alias("tokens")), grams=g).rank(q).withColumn("score", F.round("score", 9)) for t, g in ((char_ngram_tokenize, None), (word_tokenize, (3, 5))))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_written_tables_go(spark):
    import os

    t = materialise(spark.range(3))
    path = t.written_to.removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(path) and t.count() == 3
    discard(t, t, None)
    assert not os.path.exists(path)


def _disk_bytes(spark):
    """Bytes of written tables that are still there, and of all shuffles so far."""
    from pathlib import Path

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    written = sum(p.stat().st_size for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent.rglob("*.parquet"))
    return written + sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


@pytest.mark.parametrize("query", ["distractor_rate", "evidence_cov50", "evidence_recall_mrr", "retrieval_trap", "retrieval_vs_answer", "source_recall_mrr", "bm25_char_top5", "context_tokens_stats"])
def test_rankings_write_and_shuffle_less_than_the_texts(spark, query):
    from pathlib import Path

    import __spark_entry__

    sf = "/root/testdata/sf0.01"
    before = _disk_bytes(spark)
    assert __spark_entry__.queries()[query](spark, sf).count()
    assert _disk_bytes(spark) - before < Path(sf, "documents.parquet").stat().st_size


@pytest.mark.parametrize("grams", [None, (3, 5)])
def test_queries_that_are_held_rank_like_joined_ones(spark, monkeypatch, grams):
    import random

    from spanlens.functions.text import word_ngrams
    from spanlens.operators import bm25, bm25search

    rng = random.Random(9)
    words = ["ab", "été", "straße", "l'eau", "abc", "abcdef", "x"] + [f"w{i}" for i in range(12)]
    docs = [(("a", "b")[i % 2], i, [rng.choice(words) for _ in range(rng.choice((0, 1, 7, 40)))]) for i in range(80)]
    docs += [("a", 100 + i, ["abc", "w1", "w2"]) for i in range(20)] + [("c", 200, ["abc"]), (None, 201, ["abc"])]
    asked = [(f"q{i}", s, [rng.choice(words) for _ in range(3)]) for i in range(5) for s in ("a", "b")] + [("none", "a", []), ("odd", "a", ["unknown", None]), ("q0", "z", ["abc"])]
    d = spark.createDataFrame(docs, "scope string, doc_id long, tokens array<string>")
    q = spark.createDataFrame(asked, "query_id string, scope string, tokens array<string>")
    if grams:
        q = q.withColumn("tokens", word_ngrams(F.filter("tokens", lambda t: t.isNotNull()), *grams))
    for name in ("TOKENS", "HITS", "CELLS"):
        monkeypatch.setattr(bm25search, name, 50)

    def ranked(rows, k):
        monkeypatch.setattr(bm25, "ASKED_ROWS", rows)
        got = BM25Index(d, grams=grams).rank(q, k).withColumn("score", F.round("score", 9))
        return sorted(map(tuple, got.select("query_id", "doc_id", "score", "rank").collect()))

    for k in (None, 1, 4):
        assert ranked(1000, k) == ranked(0, k)


def test_places_round_as_sql_does(spark):
    import numpy as np
    from spanlens.operators.bm25search import places9

    rng = np.random.default_rng(1)
    x = np.concatenate((rng.random(2000) * 40, np.round(rng.random(2000) * 10, 9) + 5e-10, [0.0, 1.5, 2.0000000005, 0.0000000005]))
    got = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", F.round("x", 9).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == (places9(x) / 1e9).tolist()
