import random

import numpy as np

import corpus_pipeline
from spanlens.llm.queries import ORACLE, QUERIES
from spanlens.llm.tokens import default_path, encoder

PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE) <= set(QUERIES)


def write(spark, path, n=240):
    rng = random.Random(4)
    words = [a + b + c for a in ("ba", "ke", "lo") for b in ("m", "n", "st", "r") for c in ("i", "ol", "us", "")]
    docs, labels, bad = [], [], {"toxic": set(), "copy": set(), "leak": set(), "secret": set()}
    for d in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        if d % 4 == 0:
            for w in ("vile", "grubby"):
                t.insert(rng.randrange(len(t)), w)
            bad["toxic"].add(d)
        elif d % 10 == 1:
            t.insert(7, PASSAGE.title())
            bad["leak"].add(d)
        elif d % 10 == 3:
            t.insert(5, "token=abcdef123456")
            bad["secret"].add(d)
        docs.append((d, " ".join(t), "en", "src", None))
        labels.append((d, 1, int(d in bad["toxic"])))
    for d in (2, 5, 7):
        docs.append((1000 + d, docs[d][1], "en", "src", None))
        docs.append((2000 + d, docs[d][1] + " end", "en", "src", None))
        bad["copy"] |= {1000 + d, 2000 + d}
    docs += [(3000, None, None, None, None), (3001, "", "en", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, bad


def test_stages_take_effect(spark, tmp_path):
    docs, bad = write(spark, str(tmp_path))
    frame, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {d[0] for d in docs}
    columns = frame.columns
    for (name, stage), gone in zip(corpus_pipeline.STAGES, ("toxic", "copy", "leak", None, None), strict=True):
        out = corpus_pipeline.materialise(stage(spark, frame, str(tmp_path)))
        if name == "packing":
            ids = {r.doc_id: encoder(default_path()).ids(r.text or "") for r in frame.collect()}
            got = {}
            for r in out.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + r.length
            assert got == {d: len(i) + 1 for d, i in ids.items()}
            continue
        assert out.columns == columns
        kept = {r.doc_id for r in out.collect()}
        assert kept == left - (bad[gone] if gone else set()), name
        frame, left = out, kept
    assert all("[SECRET]" in r.text for r in frame.collect() if r.doc_id in bad["secret"])
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in whole} == left
    _, of = np.unique([r.sequence_id for r in whole], return_inverse=True)  # ids of partitions differ in high bits
    assert np.bincount(of, weights=[r.length for r in whole]).max() <= 1024


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path), 40)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_edited_copies_from_80_percent_go(spark, tmp_path):
    rng = random.Random(8)
    rows, share = [], {}
    for d, edits in enumerate((1, 2, 2, 2, 3)):  # of 96 shingles each edit changes five
        words = [f"d{d}w{rng.randrange(10**6)}" for _ in range(100)]
        rows.append((d, " ".join(words)))
        for e in range(edits):
            words[20 + 20 * e] = f"edit{e}"
        rows.append((100 + d, " ".join(words)))
        share[100 + d] = (96 - 5 * edits) / (96 + 5 * edits)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(0.8 <= s < 0.85 for s in share.values()) == 3 and min(share.values()) < 0.8
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()}
    assert kept == {0, 1, 2, 3, 4} | {d for d, s in share.items() if s < 0.8}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in QUERIES["op9_minhash"](spark, str(tmp_path)).collect() if r.kept} == {0, 1, 2, 3, 4} | {d for d, s in share.items() if s < 0.85}
