import json

import pytest
from pyspark.sql import functions as F

from spanlens import report
from spanlens.operators import analysis, answer, lexgap
from spanlens.sources import contracts, readers
from spanlens.streaming import resume

SPAN = "struct<status:string,start:int,end:int>"
KINDS = ["correct", "misunderstand", "distractor_span", "no_support"]


def preds(spark, rows):
    return spark.createDataFrame(rows, "config_id string, question_id string, is_correct boolean, semantic_choice string")


def test_accuracy_and_memberships(spark):
    df = spark.createDataFrame([("a", "q1", True, ["X", "Y"], "t"), ("a", "q2", True, ["X"], None), ("a", "q3", True, [], "t"), ("a", "q4", False, None, "t")], "config_id string, question_id string, is_correct boolean, cats array<string>, kind string")
    assert tuple(analysis.accuracy_table(df, ["config_id"]).first()) == ("a", 4, 3, 0.75)
    assert {r.kind: r.n for r in analysis.accuracy_table(df, ["kind"]).collect()} == {"t": 3, None: 1}
    assert {r.c: (r.n, r.accuracy) for r in analysis.accuracy_by_membership(df, "cats", ["config_id"], "c").collect()} == {"X": (2, 1.0), "Y": (1, 1.0)}
    views = analysis.accuracy_views(df, [["config_id"], ["kind"]]).collect()
    assert len(views) == 3 and len({r.view for r in views}) == 2
    got = analysis.with_bootstrap(df, ["kind"], n_boot=200).where("kind is null").first()
    assert (got.ci_low, got.ci_high) == (1.0, 1.0)


def test_confusion(spark):
    rows = [("a", f"q{i}", c == "correct", c) for i, c in enumerate(["correct"] * 4 + ["misunderstand"] * 3 + ["distractor_span"] * 2 + [None])]
    r = analysis.confusion_table(preds(spark, rows), ["config_id"]).first()
    assert [r[f"pct_{c}"] for c in analysis.CHOICES] == [0.4, 0.3, 0.2, 0.0, 0.1] and r.n == 10


def test_paired_tests(spark):
    rows = [("a", f"q{i}", i < 9, None) for i in range(12)] + [("b", f"q{i}", i in (8, 9, 10), None) for i in range(12)] + [("c", "q0", True, None)]
    got = {(r.config_a, r.config_b): r for r in analysis.compare_configs(preds(spark, rows)).collect()}
    ab = got["a", "b"]
    assert (ab.n, ab.n10, ab.n01) == (12, 8, 2) and ab.p_value == pytest.approx(0.109375) and got["a", "c"].n == 1
    matrix = {(r.config_a, r.config_b): r.p_value for r in analysis.significance_matrix(preds(spark, rows), ["a", "b"]).collect()}
    assert matrix["a", "a"] is None and matrix["a", "b"] == matrix["b", "a"] and len(matrix) == 4
    wide = {r.config_a: r for r in analysis.significance_wide(preds(spark, rows)).collect()}
    assert wide["b"]["a"] == pytest.approx(0.109375)


def geometry(spark):
    chunks = spark.createDataFrame([("c1", "t", 0, 10), ("c2", "t", 10, 20), ("c3", "u", 0, 10)], "chunk_id string, text_id string, start_char int, end_char int")
    e = lambda a, b: ("exact", a, b)
    qs = [("both", e(0, 5), e(12, 14)), ("crit", e(0, 5), e(30, 40)), ("lure", e(30, 40), e(0, 5)), ("none", e(30, 35), e(36, 40)), ("open", ("unresolved", None, None), e(0, 5))]
    questions = spark.createDataFrame([(q, "t", c, d) for q, c, d in qs], f"question_id string, text_id string, critical_span {SPAN}, distractor_span {SPAN}")
    ranks = spark.createDataFrame([(q, c, i + 1) for q, *_ in qs for i, c in enumerate(["c1", "c2", "c3"])], "question_id string, chunk_id string, rank int")
    return chunks, questions, ranks


def test_diagnostics(spark, tmp_path):
    chunks, questions, ranks = geometry(spark)
    p = preds(spark, [("x", "both", True, "correct"), ("x", "crit", True, "correct"), ("x", "lure", False, "distractor_span"), ("x", "open", True, "correct")])
    critical, lure = (analysis.span_hits(ranks, chunks, questions, 2, s) for s in ("critical_span", "distractor_span"))
    got = {r.group: r for r in analysis.retrieval_trap(p, critical, lure).collect()}
    assert {g: r.n for g, r in got.items()} == {"distractor only": 1, "both": 1, "critical only": 1, "neither": 0}
    assert got["neither"].accuracy is None and got["distractor only"].pct_distractor == 1.0
    flat = {r.group: (r.n, r.n_correct, r.n_incorrect, r.accuracy) for r in analysis.retrieval_vs_answer(p, critical).collect()}
    assert flat == {"retrieved": (2, 2, 0, 1.0), "missed": (1, 0, 1, 0.0)}
    path = report.table_retrieval_trap(p, ranks, chunks, questions, 2, str(tmp_path))
    assert "| neither | 0 | 0 |  | 0 |  |" in path.read_text() and json.loads((tmp_path / "retrieval_trap.meta.json").read_text()) == {"k": 2}


def test_prompts(spark):
    df = spark.createDataFrame([("Wien {x} 5%?", {c: f"opt {c}" for c in "ABCD"}, None), ("Q", {c: c for c in "ABCD"}, "")], "q string, p map<string,string>, c string")
    closed, opened = (r.x for r in df.select(answer.build_prompt(F.col("q"), F.col("p"), F.col("c")).alias("x")).collect())
    assert closed == answer.CLOSED_PROMPT.replace("{question}", "Wien {x} 5%?").replace("{option_a}", "opt A").replace("{option_b}", "opt B").replace("{option_c}", "opt C").replace("{option_d}", "opt D")
    assert "Context: \n\nQuestion: Q" in opened and len(answer.prompt_template_hash()) == 16


def test_contexts(spark):
    chunks = spark.createDataFrame([("a", "first"), ("b", "second")], "chunk_id string, chunk_text string")
    ranks = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "question_id string, chunk_id string, rank int")
    r = answer.retrieval_context(ranks, chunks, 5).first()
    assert (r.context, r.context_chunk_ids) == ("second\n\nfirst", ["b", "a"])
    with pytest.raises(ValueError):
        answer.retrieval_context(ranks, chunks, 0)
    with pytest.raises(Exception, match="unknown chunk"):
        answer.retrieval_context(ranks.union(spark.createDataFrame([("q", "z", 3)], ranks.schema)), chunks, 5).collect()
    texts = spark.createDataFrame([("t", "Body")], "text_id string, body string")
    qs = spark.createDataFrame([("q", "t")], "question_id string, text_id string")
    assert tuple(answer.full_context(qs, texts).first()) == ("q", "Body", ["t_full"])


def test_run_and_resume(spark, tmp_path):
    qs = spark.createDataFrame([(f"text1_q0{i}", f"question {i}", {c: c for c in "ABCD"}, KINDS, "A") for i in range(1, 6)], "question_id string, question string, presented map<string,string>, permutation array<string>, gold_letter string")
    config = answer.RunConfig("closed_book", limit=2)
    client = answer.MockClient(substrings={"question 2": "**B**", "question 4": "no idea"}, default="A")
    out = str(tmp_path)
    first = answer.run(config, client, qs, None, out)
    assert (first["n_new"], first["skipped"], first["correct"], first["accuracy_new"]) == (2, 0, 1, 0.5)
    config.limit = None
    second = answer.run(config, client, qs, None, out)
    assert second["config_id"] == first["config_id"] and (second["n_new"], second["skipped"], second["unparseable"]) == (3, 2, 1)
    third = answer.run(config, client, qs, None, out)
    assert (third["n_new"], third["accuracy_new"]) == (0, None)
    log = readers.read_predictions(spark, out)
    assert log.count() == 5 and {r.config_id for r in log.collect()} == {first["config_id"]}
    contracts.check(contracts.prediction_violations(log), "predictions")
    contracts.check(contracts.join_violations(log, qs), "join")
    base = answer.random_baseline(qs, 3).collect()
    assert {r.question_id: r.raw_output for r in base} == {r.question_id: r.raw_output for r in answer.random_baseline(qs.repartition(3), 3).collect()}


def test_resilience(spark):
    class Flaky:
        def __init__(self, *errors):
            self.errors = list(errors)

        def complete(self, prompt):
            if self.errors:
                raise RuntimeError(self.errors.pop(0))
            return "C"

    waits = []
    assert answer.complete_resilient(Flaky("busy", "busy"), "", sleep=waits.append) == "C" and waits == [2.0, 4.0]
    with pytest.raises(answer.TerminalError):
        answer.complete_resilient(Flaky("insufficient_quota"), "", sleep=waits.append)
    prompts = spark.createDataFrame([("q1", "p")], "question_id string, prompt string")
    assert answer.answers(prompts, answer.MockClient(responder=lambda p: 1 / 0), backoff=0).first().raw_output.startswith("<<error: ZeroDivisionError")
    qs = spark.createDataFrame([("q1", KINDS, "A")], "question_id string, permutation array<string>, gold_letter string")
    got = answer.graded(spark.createDataFrame([("q1", "<<error: X: A>>")], "question_id string, raw_output string"), qs).first()
    assert (got.parsed_letter, got.parse_status, got.is_correct) == (None, "error", False)


def test_configs():
    a = answer.RunConfig("bm25", rankings="/x/r.jsonl", k=5)
    assert answer.config_id(a) == answer.config_id(answer.RunConfig("bm25", rankings="/other/r.jsonl", k=5, limit=3)) != answer.config_id(answer.RunConfig("bm25", rankings="/x/r.jsonl", k=3))
    assert [len(answer.grid(t)) for t in ("full", "reduced", "minimal")] == [16, 10, 6]


def question(**change):
    base = dict(question_id="text1_q01", text_id="text1", cognitive_type="Retrieve", options={k: "x" for k in KINDS}, presented={c: "x" for c in "ABCD"}, permutation=KINDS, gold_letter="A", critical_span=("exact", 0, 4, False), distractor_span=("empty", None, None, False), linguistic_tags=[], linguistic_categories=[])
    return base | change


def test_question_contract(spark):
    schema = "question_id string, text_id string, cognitive_type string, options map<string,string>, presented map<string,string>, permutation array<string>, gold_letter string, critical_span struct<status:string,start:int,end:int,in_title:boolean>, distractor_span struct<status:string,start:int,end:int,in_title:boolean>, linguistic_tags array<string>, linguistic_categories array<string>"

    def found(*rows):
        return {r.message for r in contracts.question_violations(spark.createDataFrame(list(rows), schema)).collect()}

    assert found(question()) == set() == found(question(critical_span=("exact", None, None, True)))
    assert found(question(), question()) == {"not unique"}
    for change, message in (({"gold_letter": "B"}, "gold_letter"), ({"critical_span": ("exact", 5, 5, False)}, "critical_span"), ({"distractor_span": ("empty", 0, 1, False)}, "distractor_span"), ({"cognitive_type": "Guess"}, "unknown cognitive_type"), ({"question_id": "text2_q01"}, "question_id of another text"), ({"linguistic_tags": None}, "tags"), ({"presented": {"A": "x"}}, "presented keys"), ({"critical_span": ("exact", 1, 2, True)}, "critical_span")):
        assert found(question(**change)) == {message}
    with pytest.raises(contracts.SchemaError):
        contracts.check(contracts.question_violations(spark.createDataFrame([question(gold_letter="B")], schema)), "questions")


def test_other_contracts(spark):
    long = spark.createDataFrame([("q", "a", 1, "s"), ("q", "b", 3, "t")], "question_id string, chunk_id string, rank int, setting string")
    assert {r.message for r in contracts.ranking_violations(long).collect()} == {"ranks are not 1..n", "mixed settings"}
    chunks = spark.createDataFrame([("text1_overlap_c1000", "text1", 0, 4), ("text1_overlap_c01", "text2", 4, 4)], "chunk_id string, text_id string, start_char int, end_char int")
    assert {r.message for r in contracts.chunk_violations(chunks).collect()} == {"bad chunk_id", "chunk_id of another text", "offsets"}


def test_readers(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts/text1.txt").write_bytes("Titel\r\nAuteur\r\nÉischt Linn\r\n\r\nZweet ".encode())
    (tmp_path / "texts/text2.txt").write_text("Nëmmen Titel\nKierper")
    rows = {r.text_id: r for r in readers.read_texts(spark, str(tmp_path / "texts"), author_optional=True).collect()}
    assert rows["text1"].body == "Éischt Linn\n\nZweet " and rows["text1"].author == "Auteur" and (rows["text2"].author, rows["text2"].body) == (None, "Kierper")
    q = {k: "x" for k in contracts.RAW_QUESTION_KEYS} | {"cognitiveType": "Retrieve"}
    (tmp_path / "kb").write_text(f"'Titel': {[q, q]!r},\n\n")
    got = readers.read_collection(spark, str(tmp_path / "kb"), readers.read_texts(spark, str(tmp_path / "texts"), True)).orderBy("question_id").collect()
    assert [r.question_id for r in got] == ["text1_q01", "text1_q02"] and got[0].options["correct"] == "x"
    with pytest.raises(contracts.SchemaError):
        readers.parse_collection_line("'T': [{'question': 'x'}]")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    assert [r._corrupt is None for r in readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=False).collect()] == [True, False]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_rankings_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("q", "open", "bm25", "m", "p", "b", 0.5, 2), ("q", "open", "bm25", "m", "p", "a", 0.9, 1)], "question_id string, setting string, method string, query_mode string, chunk_strategy string, chunk_id string, score double, rank int")
    readers.write_rankings(long, str(tmp_path / "r"))
    back = readers.long_rankings(spark.read.schema(contracts.RANKING).json(str(tmp_path / "r")))
    assert sorted((r.chunk_id, r["rank"]) for r in back.collect()) == [("a", 1), ("b", 2)]
    assert readers.rankings_filename("s", "m", "c", "q") == "rankings_s_m_c_q.jsonl"
    assert spark.createDataFrame([("text1_my_way_c012",)], "c string").select(readers.infer_strategy(F.col("c"))).first()[0] == "my_way"


def test_lexical_gap(spark):
    df = spark.createDataFrame([(1, ["schoul", "an", "haus"], ["schoulen", "haus", "an"]), (2, ["qqq"], [])], "pair_id int, q_words array<string>, s_words array<string>")
    assert {(r.pair_id, r.word): r.kind for r in lexgap.classify(df).collect()} == {(1, "schoul"): "subword", (1, "haus"): "exact", (2, "qqq"): "none"}
    assert tuple(lexgap.exact_share(df).first()) == (3, 1, pytest.approx(1 / 3))
    assert {r.pair_id: r.word_jaccard for r in lexgap.similarities(df).collect()} == {1: 0.5, 2: 0.0}


def test_streaming_append(spark, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "config_id string, question_id string"

    def add(*ids):
        spark.createDataFrame([("c", q) for q in ids], schema).coalesce(1).write.mode("append").json(source)
        resume.append_new(spark.readStream.schema(schema).json(source), lambda df: df.withColumn("x", F.lit(1)), log, str(tmp_path / "cp")).awaitTermination()

    add("q1", "q2", "q2")
    add("q2", "q3")
    assert sorted(r.question_id for r in spark.read.parquet(log).collect()) == ["q1", "q2", "q3"]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z")], "k string, ts int, v string")
    assert sorted(tuple(r) for r in resume.first_per_key(df, ["k"], "ts").select("k", "ts", "v").collect()) == [("a", 1, "y"), ("b", 1, "z")]


def test_markdown(spark):
    df = spark.createDataFrame([("a", 0.12345, None)], "x string, y double, z int")
    assert report.to_markdown(df) == "| x | y | z |\n| --- | --- | --- |\n| a | 0.123 |  |"
