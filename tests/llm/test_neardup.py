import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlens.llm import neardup, toxicity
from spanlens.llm.components import components
from spanlens.llm.shingles import Numbered, circulant, linked, shingle_sets, words_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for size in (1, 1, 1, 2, 5, 40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 200]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((doc, " ".join(copy)))
            doc += rng.randint(1, 3)
    chain = [rng.choice(words) for _ in range(100)]
    for i in range(25):  # each like the one before, the ends unlike
        chain[4 * i : 4 * i + 2] = [f"c{i}", f"d{i}"]
        rows.append((500 + i, " ".join(chain)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "a b c d e"), (3, "a b"), (906, rows[0][1]), (906, rows[0][1]), (907, "été " * 40), (None, "a b")]


def run(spark, table, **how):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in table], "doc_id long, text string, key int, label string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, **how).collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows, 80)
    assert run(spark, rows, percent=85, bands=25) == brute(rows, 85)


def test_blocks_and_low_thresholds(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK", 3)
    monkeypatch.setattr(neardup, "_STAR", 2)
    monkeypatch.setattr(neardup, "_NUMBERED", 50)
    monkeypatch.setattr("spanlens.storage.SMALL_ROWS", 0)
    rows = corpus(5)
    assert run(spark, rows, percent=70, rows=3, bands=40) == brute(rows, 70)


def test_empty_table_and_keep_one(spark):
    assert run(spark, []) == []
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, None)]
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, gone_id long")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_circulant_estimates_jaccard():
    rng = np.random.default_rng(1)
    c = circulant(125)
    for share in (0.5, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(1 << 63, size=400, dtype=np.uint64)
            own = int(400 * (1 - share) / (1 + share))
            a, b = (np.concatenate((both[: 400 - own], rng.integers(1 << 63, size=own, dtype=np.uint64))) for _ in range(2))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append((c.signature(a) == c.signature(b)).mean() - j)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_shingle_sets_count_distinct_sequences():
    texts = ["a b c d e a b c d e a", "", "x", "É é", "one two three four", "q " * 50]
    words = [words_of(t.encode()) for t in texts]
    assert [len(s) for s in shingle_sets(words)] == [len(shingles(t)) for t in texts]
    numbered = Numbered()
    assert [len(numbered.set_of(w)) for w in words] == [len(shingles(t)) for t in texts]


def test_numbered_sets_meet_as_sets_of_words_do():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    numbered = Numbered()
    own = [numbered.set_of(words_of(t.encode())) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = shingles(a), shingles(b)
            assert linked(own[i], own[j], 70) == (bool(x and y) and 100 * len(x & y) >= 70 * len(x | y))


def test_words_with_equal_polynomial_hashes_stay_apart(spark):
    word = "a"
    for _ in range(11):  # the sequence of 2,048 letters on which polynomial hashes modulo 2 ** 64 fail
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    assert run(spark, rows) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_sets_are_confirmed_where_all_hashes_are_equal(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_set_hashes", lambda s: (1, 1))
    rows = [(1, "a b c d e f"), (2, "u v w x y z"), (3, "A b  c d e f"), (4, "q q q q q q"), (5, "q q q q q q q"), (6, "r r r r r r")]
    local = spark.createDataFrame(rows, "doc_id long, text string")
    equal = neardup.verified(spark.createDataFrame([(1, 2), (4, 5), (4, 6), (1, 3)], "u long, v long"), local, 100)
    assert sorted(map(tuple, equal.collect())) == [(1, 3), (4, 5)]


def test_exact_candidates(spark):
    rows = corpus(9)
    assert run(spark, rows, exact=True) == brute(rows, 80)
    assert run(spark, rows, percent=60, exact=True) == brute(rows, 60)


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i % 7919}x{i % 104729}" for i in range(200_000))
    rows = [(1, long), (2, long + " end"), (3, "w " * 300_000), (4, "y" * 2_000_000), (5, None)]
    names = ("u", "v", "block", "role", "key", "n", "label", "sig", "copy", "gone_id", "node", "component")
    df = spark.createDataFrame([(d, t, *[f"{c}{d}" for c in names]) for d, t in rows], f"doc_id long, text string, {', '.join(c + ' string' for c in names)}")
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.role, r.component) for r in kept.collect()) == [(d, f"role{d}", f"component{d}") for d in (1, 3, 4, 5)]


def test_components_of_a_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(60)] + [(100 + i, 200) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 140), 200]}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def toxic_rows(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ta", "no", "ri", "el") for b in ("m", "st", "x", "pp", "ur")]
    rows, labels = [], []
    for d in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = d % 3 == 0
        if toxic:
            for w in rng.sample(["vile", "vilest", "grubby", "grubbier"], 2):
                t.insert(rng.randrange(len(t)), w)
        if d % 2:
            t.insert(3, "größe")
        rows.append((d, " ".join(t)))
        labels.append((d, int(toxic)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(d, t, "en", 1) for d, t in rows] + [(1000, None, "en", 1), (1001, "", "de", 1)], "doc_id long, text string, lang string, toxic int")
    known = spark.createDataFrame([*labels, (5000, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_labelled(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [d for d, _ in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    right = sum(got[d].predicted == dict(labels)[d] for d in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[1000].predicted == got[1001].predicted == 0
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.predicted}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = toxicity.fit_labelled(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def rows_beyond_a_sample(spark, n=3400):
    """Texts and labels of which the 150 toxic rows of the greatest hashes alone say grubby, and held-out texts that do, or not."""
    ids = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)))
    ids = ids.withColumn("held", toxicity.held_out()).orderBy("h").collect()
    own, held = [r.doc_id for r in ids if not r.held], [r.doc_id for r in ids if r.held]
    rng = random.Random(4)

    def text(*more):
        words = [rng.choice("ta tam no nost ri rix el elpp um".split()) for _ in range(rng.randint(10, 20))]
        return " ".join([*words, *more, rng.choice(words)])

    toxic = [(d, text("vile")) for d in own[:1700]] + [(d, text("grubby")) for d in own[-150:]]
    clean = [(d, text()) for d in own[1700:-150]]
    asked = [(d, text(*["grubby"] * (i % 2))) for i, d in enumerate(held[:200])]
    docs = spark.createDataFrame(toxic + clean + asked, "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1) for d, _ in toxic] + [(d, 0) for d, _ in clean], "doc_id long, toxic int")
    return docs, labels, {d: int("grubby" in t) for d, t in asked}


def test_all_labelled_rows_are_learnt_from(spark):
    docs, labels, want = rows_beyond_a_sample(spark)
    model = toxicity.fit_labelled(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect() if r.doc_id in want}
    assert sum(got[d] == y for d, y in want.items()) >= 0.97 * len(want)


def test_partitions_do_not_change_the_model(spark):
    docs, labels, want = rows_beyond_a_sample(spark)
    several = toxicity.fit_labelled(docs, labels, group_bytes=60_000)
    again = toxicity.fit_labelled(docs.union(docs.limit(50)).repartition(7), labels.union(labels).repartition(3), group_bytes=60_000)
    for name in ("table", "bias", "out", "out_bias", "cuts"):
        assert np.array_equal(getattr(several, name), getattr(again, name)), name
    assert all(np.array_equal(a, b) for a, b in zip(several.filters, again.filters, strict=True))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, several).collect() if r.doc_id in want}
    assert sum(got[d] == y for d, y in want.items()) >= 0.97 * len(want)


def test_groups_of_one_label_count():
    rows, labels = toxic_rows(120)
    sums = []
    for order in (1, -1):
        learnt = toxicity.Learnt()
        for part in [slice(0, None, 3), slice(1, None, 3), slice(0, 60), slice(60, None)][::order]:  # a toxic group, a clean one, two mixed ones
            learnt.add([t.encode() for _, t in rows[part]], [y for _, y in labels[part]], steps=5)
        sums.append(learnt.sums)
    assert np.array_equal(*sums)
    assert sums[0][-1, :2].tolist() == [120, 80]
    word = toxicity.word_ids([b"vile"])[0][0, 0]
    assert sums[0][word, :2].tolist() == [0, 2 * sum("vile" in t.split() for _, t in rows)] and sums[0][word, 2] == 2


def test_threshold_counts_rows():
    rng = np.random.default_rng(5)
    for _ in range(50):
        z, clean, toxic = rng.integers(-4, 5, 12) / 2.0, rng.integers(0, 4, 12), rng.integers(0, 4, 12)
        toxic[0] += 1

        def f1(cut):
            hit, called = toxic[z >= cut].sum(), (clean + toxic)[z >= cut].sum()
            return 2 * hit / (called + toxic.sum())

        cut = toxicity._threshold(z, clean, toxic)
        assert cut not in z and f1(cut) == pytest.approx(max(f1(c) for c in np.arange(-5, 6, 0.25)))


def test_scores_do_not_depend_on_the_batch():
    rows, labels = toxic_rows(120)
    model = toxicity.fit([(t.encode(), y) for (_, t), (_, y) in zip(rows, labels, strict=True)], steps=40)
    texts = [t.encode() for _, t in rows[:20]] + [b"", b"vile"]
    assert model.scores(texts) == pytest.approx(np.concatenate([model.scores([t]) for t in texts]), abs=1e-5)


def small_model(seed=3):
    rng = np.random.default_rng(seed)
    n = toxicity.FILTERS * len(toxicity.WIDTHS)
    filters = [rng.standard_normal((w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    return toxicity.Model(rng.standard_normal((1 << toxicity.BITS, toxicity.DIM)), filters, rng.standard_normal(n) * 0.1, rng.standard_normal(n), 0.2, np.zeros(4))


TOXIC_TEXTS = [b"one two three four", b"a", b"", b"vile words here are vile", b"x y", b"two three"]


def plain_logit(model, words):
    """The classifier's logit by loops over filters and windows."""
    emb = [model.table[r].sum(axis=0) for r in words]
    out = model.out_bias
    for i, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            c = i * toxicity.FILTERS + f
            acts = [sum(float(emb[p + j] @ model.filters[i][j][:, f]) for j in range(width)) + model.bias[c] for p in range(len(words) - width + 1)]
            out += max([0.0, *acts]) * model.out[c]
    return out


def test_classifier_matches_loops():
    model = small_model()
    ids, starts, _ = toxicity.word_ids(TOXIC_TEXTS)
    want = [plain_logit(model, ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert model.logits(ids, starts) == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_gradients_match_differences():
    model, y = small_model(), np.array([1, 0, 0, 1, 0, 1], float)
    ids, starts, _ = toxicity.word_ids(TOXIC_TEXTS)

    def loss():
        z = np.array([plain_logit(model, ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)])
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads, by_bias, which, by_table = model.gradients(ids, starts, y)
    rng = np.random.default_rng(1)
    pairs = list(zip([*model.filters, model.bias, model.out], grads, strict=True))
    for array, grad in [*pairs, (model.table, None)]:
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in array.shape)
            if grad is None:
                k = int(rng.integers(len(which)))
                at = (int(which[k]), at[1])
            had, e = array[at], 1e-5
            array[at] = had + e
            up = loss()
            array[at] = had - e
            down = loss()
            array[at] = had
            assert (up - down) / (2 * e) == pytest.approx(float(grad[at] if grad is not None else by_table[k, at[1]]), rel=1e-3, abs=1e-5)
    had, model.out_bias = model.out_bias, model.out_bias + 1e-5
    up = loss()
    model.out_bias = had - 1e-5
    assert (up - loss()) / 2e-5 == pytest.approx(by_bias, rel=1e-3, abs=1e-6)
