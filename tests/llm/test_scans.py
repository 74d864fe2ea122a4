import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanlens.llm import decontam, quality, secretscan, urlfilter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))


def brute_decontam(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(len(w) - size, 0) + 1) if w else ():
            wins.setdefault(tuple(w[p : p + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for win, ids in wins.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    got |= ids
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen"
DOCS = [(1, "zero " + ITEM + " end"), (2, "one two THREE four five six seven eight nine nine"), (3, None), (4, ""), (5, "été 12 Rare, rare rare"), (6, "été 12 Rare, rare rare"), (6, "été 12 Rare, rare rare"), (None, "x tiny y tiny"), (8, "!?"), (9, ITEM.replace(" ", "--") + " " + ITEM), (10, "word " * 500), (11, "six seven eight nine ten eleven twelve thirteen one two")]
ITEMS = [(1, ITEM), (2, ITEM), (10, "tiny"), (3, None), (4, "..."), (5, "rare rare"), (7, "absent words only"), (None, "12 rare"), (12, "word " * 11)]


def test_decontamination(spark):
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in DOCS], "doc_id long, text string, tie int, pos int, term string").repartition(3)
    items = spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, window string")
    got = sorted((tuple(r) for r in decontam.report(docs, items).drop("tie").collect()), key=str)
    assert got == brute_decontam(DOCS, ITEMS)
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in DOCS if not next(r for r in brute_decontam([(d, t)], ITEMS))[5])


def test_decontamination_by_shuffle_and_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SMALL_ROWS", 0)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in decontam.report(docs, items).drop("tie").collect()), key=str) == brute_decontam(DOCS, ITEMS)
    assert decontam.report(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in decontam.report(docs, items.limit(0)).collect()} == {False}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha beta"), (3, "beta " + "x " * 20 + "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    got = {r.doc_id: r.apart for r in decontam.Index(docs, items).near(4).collect()}
    assert got == {1: 2, 2: 0}


def brute_quality(d, t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup, lines = set(), 0, [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return (d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines), dup, len(rep), failed)


def test_quality(spark):
    good = " ".join(f"word{i} and{i % 7}" for i in range(60))
    rows = [(1, good), (2, None), (3, ""), (4, "a b c a b c"), (5, good + "\n" + good), (6, "x\n\nx\n \nx\ny"), (7, "a a a a a"), (8, " ".join(w + "%%%" for w in good.split())), (9, ("line one\n" * 30) + good), (None, good), (1, good), (10, "é " * 80), (11, "1 2 3 4 " + good + " 2 3 4 5")]
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id long, text string, low int, words string")
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect()}
    assert got == {brute_quality(d, t) for d, t in rows}
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert kept[1] and kept[11] and not kept[8] and not kept[9] and not kept[5]
    assert quality.judge(df.limit(0)).count() == 0


def test_cascade_stops_early_and_order_does_not_matter(spark):
    df = spark.createDataFrame([(i,) for i in range(9)], "v int")
    rules = {"small": "v < 3", "odd": "v % 2 = 1", "never": "v < 0 or raise_error('evaluated') is null"}
    a = df.where("v < 3 or v % 2 = 1").select(quality.cascade(["small", "odd", "never"], rules).alias("r")).collect()
    assert [r.r for r in a] == ["small"] * 3 + ["odd"] * 3
    safe = {k: rules[k] for k in ("small", "odd")}
    both = df.select(quality.cascade(["small", "odd"], safe).isNull().alias("a"), quality.cascade(["odd", "small"], safe).isNull().alias("b")).collect()
    assert all(r.a == r.b for r in both)


def brute_secrets(t):
    out, t = [], t or ""
    kinds = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for rank, (kind, p, group, least) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(t) if len(m[group]) >= least]
    return ",".join(x for _, _, x in sorted(out))


SECRETS = ["", None, "token: token = abcdefg", "é😀 password = 'abcdef' x", "PASSWORD:abc", "api_key=aaaaaa apikey: \"bbbbbbb\"", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 12, "AKIA123", "f" * 24 + "g" + "0" * 23, "deadbeef" * 4 + "é" + "deadbeef" * 3, "secret=" + "a" * 30, "passwd==x.y/z+1", "tokentoken=123456789", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1B2" * 9, "token='short' token='longer1'"]


def test_secrets(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(SECRETS)] + [(3, SECRETS[3], "x"), (None, SECRETS[6], "x")], "doc_id long, text string, found string").repartition(3)
    rows = secretscan.report(df).collect()
    assert len(rows) == len(SECRETS) + 2
    for r in rows:
        want = brute_secrets(SECRETS[6 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (r, want)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in secretscan.BASE] == [s for s in want.split(",") if s]
    assert {r.doc_id for r in rows if "private_key" in r.spans or "code_host" in r.spans} == {14, 15}
    assert secretscan.report(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é token=abcdef12 ok", 19), (2, "clean", 5), (3, None, 0), (4, "x" + "a" * 40, 41), (5, "secret=" + "a" * 30 + " z", 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in secretscan.redact(df).collect()}
    assert got == {1: ("é [SECRET] ok", 13), 2: ("clean", 5), 3: ("", 0), 4: ("x[SECRET]", 9), 5: ("[SECRET] z", 10)}


def test_columns_of_internal_names_pass_through_redaction(spark):
    names = ("tie", "found", "of_id", "of_tie", "rule_0", "found_0", "own", "runs", "new", "gram", "mask")
    rows = [(1, "x token=abcdef12"), (2, "clean"), (None, "secret: abcdefgh"), (1, "x token=abcdef12")]
    df = spark.createDataFrame([(d, t, *[f"{c}{i}" for c in names]) for i, (d, t) in enumerate(rows)], f"doc_id long, text string, {', '.join(c + ' string' for c in names)}")
    got = secretscan.redact(df)
    assert got.columns == df.columns
    want = ["x [SECRET]", "clean", "[SECRET]", "x [SECRET]"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(d, want[i], *[f"{c}{i}" for c in names]) for i, (d, _) in enumerate(rows)], key=str)


def test_candidates_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)], "doc_id long, text string")
    few = sorted(map(tuple, secretscan.report(df).collect()))
    monkeypatch.setattr("spanlens.storage.SMALL_ROWS", -1)
    assert sorted(map(tuple, secretscan.report(df).collect())) == few


def test_long_texts(spark):
    """Each scan reads texts of some MB in time that grows with their length."""
    rows = [(1, "token=abcdef12 x\n" * 20_000), (2, " ".join(f"w{i}" for i in range(100_000)) + " " + ITEM), (3, "z" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    red = {r.doc_id: r.text for r in secretscan.redact(df).collect()}
    assert red[1] == "[SECRET] x\n" * 20_000 and red[2] == rows[1][1]
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontam.report(df, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert hit == {1: (60_000, 0), 2: (100_013, 13), 3: (1, 0)}
    judged = {r.doc_id: (r.n_words, r.base_failed) for r in quality.judge(df).collect()}
    assert judged == {1: (40_000, True), 2: (100_013, False), 3: (1, True)}
    assert time.perf_counter() - began < 240


def test_no_list_of_words_is_shuffled(spark, monkeypatch):
    """Beyond the broadcast bound, rows that are shuffled hold no text and no list of a text's words."""
    monkeypatch.setattr(decontam, "SMALL_ROWS", -1)
    docs = spark.createDataFrame([(1, "a b " * 50 + ITEM)], "doc_id long, text string")
    index = decontam.Index(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    for df in (index.docs.select("doc_id", "tie", F.posexplode("w").alias("pos", "term")).join(index.plans.select(F.col("term1").alias("term")), "term"), index._lists()[0]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
        for line in plan.splitlines():
            if "Exchange hashpartitioning" in line:
                assert "w#" not in line and "text#" not in line


def test_trigram_queries():
    q = secretscan.trigram_query
    assert q("[0-9a-f]+") is True and q("a.c") is True
    assert q("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))
    assert q("abc|abd") == ("or", frozenset({"abc", "abd"}))
    assert q("(abc)?xyz") == ("or", frozenset({"xyz", ("and", frozenset({"abc", "bcx", "cxy", "xyz"}))}))
    assert secretscan.grams(q(secretscan.RULES[0].pattern)) >= {"pas", "ecr", "tok", "key"}


def test_every_match_satisfies_its_query():
    def true(query, text):
        return query is True or (query in text if isinstance(query, str) else (all if query[0] == "and" else any)(true(x, text) for x in query[1]))

    for rule in secretscan.RULES:
        for t in SECRETS:
            if t and re.search(rule.pattern, t):
                assert true(secretscan.trigram_query(rule.pattern), t.translate(LOW))


def brute_rule(h, p):
    fit = [r for r in urlfilter.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text)) if fit else None


URLS = [None, "", "no scheme", "http://a.org/x", "HTTP://WWW.Example.ORG/es/1?q", "https://example.org/en/1#x", "https://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://xcom/fr/1", "http://x.com", "a://b://c/d", "http://h.net?x=/fr/", "http://example.org/es", "//q.org/", "http://Ö.com/fr/x"]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(URLS)] + [(3, URLS[3], "<p>", "h")], "page_id long, url string, html string, host string")
    rows = urlfilter.judge(df).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        u = URLS[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].translate(LOW)
        path = re.match("[^?#]*", rest[len(host) :])[0]
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule.text, rule.verdict if rule else "allow")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_distrust_flows_against_links(spark):
    bad, good = "bad.com", "good.org"
    pages = [(i, f"http://{bad}/de/{i}", "") for i in range(4)] + [(10 + i, f"http://{good}/{i}", f'<a href="http://fine.net/x">') for i in range(4)]
    pages += [(20, "http://spam.net/a", f'<a href="//{bad}/de/1"> <A HREF=http://{bad}>'), (21, "http://fine.net/", "<a href='/x'>"), (22, "http://far.net/", "<a href='http://spam.net'>"), (23, f"http://{bad}/en/9", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df).collect()}
    assert (got[20], got[21], got[22], got[23]) == ("block", "allow", "block", "block")


def brute_verdicts(pages, damping=0.85, rounds=600):
    """The verdict of each page by rules, and else by ranks over a link graph in plain Python."""

    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match("[^/?#]*", rest)[0]
        return h.translate(LOW), re.match("[^?#]*", rest[len(h) :])[0]

    links, good, bad, rules = {}, {}, {}, {}
    for i, u, html in pages:
        h, p = parts(u)
        rules[i] = r = brute_rule(h, p)
        if h and r:
            side = good if r.verdict == "allow" else bad
            side[h] = side.get(h, 0) + 1
        for m in re.findall(r"""href=["']([^"']+)""", html or ""):
            to = m.split("//", 1)[1].split("/")[0].translate(LOW) if "//" in m else h if not re.match("[a-z]+:", m) else ""
            if h and to:
                links[h, to] = links.get((h, to), 0) + 1
    ties = set()
    for h in {parts(u)[0] for _, u, _ in pages}:
        while h.count(".") >= 2:
            up = h.split(".", 1)[1]
            ties |= {(h, up), (up, h)}
            h = up
    for x in ties:
        links[x] = links.get(x, 0) + 1
    trust = brute_pagerank(links, good, damping, rounds) if good else {}
    distrust = brute_pagerank({(d, s): n for (s, d), n in links.items()}, bad, damping, rounds) if bad else {}
    out = {}
    for i, u, _ in pages:
        h = parts(u)[0]
        worse = distrust.get(h, 0) * sum(bad.values()) > trust.get(h, 0) * sum(good.values()) + 1e-12
        out[i] = rules[i].verdict if rules[i] else "block" if worse else "allow"
    return out


def test_verdicts_of_rules_and_ranks_match_brute_force(spark):
    rng = random.Random(12)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.com", "blog.y.com", "z.net", "www.z.net", "far.edu", "q.info", "m.q.info"]
    pages = []
    for i in range(150):
        h = rng.choice(hosts)
        to = [rng.choice(["/in", "http://" + rng.choice(hosts) + "/p", "//" + rng.choice(hosts), "mailto:x"]) for _ in range(rng.randint(0, 2))]
        lang = "/de/" if h == "a.x.com" else rng.choice(["/fr/", "/en/"]) if h.endswith("y.com") else rng.choice(["/fr/", "/de/", "/en/"])
        pages.append((i, f"https://{h}{lang}{i}", "".join(f'<a href="{t}">' for t in to)))
    want = brute_verdicts(pages)
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == want
    assert {"allow", "block"} == {r.verdict for r in got.values() if r.rule is None}


def brute_pagerank(links, seeds, damping=0.85, rounds=12):
    total = sum(seeds.values())
    start = {k: v / total for k, v in seeds.items()}
    out, rank = {}, dict(start)
    for (s, _), n in links.items():
        out[s] = out.get(s, 0) + n
    for _ in range(rounds):
        new = {k: (1 - damping) * v for k, v in start.items()}
        for (s, d), n in links.items():
            if s in rank:
                new[d] = new.get(d, 0) + damping * rank[s] * n / out[s]
        rank = new
    return rank


def test_pagerank(spark):
    links = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 3, ("a", "d"): 1, ("e", "a"): 1}
    df = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src string, dst string, n long")
    seeds = {"a": 3.0, "e": 1.0}
    got = {r.node: r.rank for r in urlfilter.propagate(df, spark.createDataFrame(list(seeds.items()), "node string, seed double")).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute_pagerank(links, seeds).items()}


def test_ranks_settle(spark):
    links = {(f"h{i}", f"h{i + 1}"): 1 for i in range(16)} | {("h16", "h15"): 1, ("h3", "x"): 2, ("h16", "y"): 3, ("y", "h16"): 1, ("y", "z"): 4, ("h5", "h5b"): 9}
    df = spark.createDataFrame([(s, d, n) for (s, d), n in links.items()], "src string, dst string, n long")
    seeds = {"h0": 3.0, "y": 1.0}
    got = {r.node: r.rank for r in urlfilter.propagate(df, spark.createDataFrame(list(seeds.items()), "node string, seed double"), rounds=None).collect()}
    assert "h16" in got and got == {k: pytest.approx(v, rel=1e-7, abs=0) for k, v in brute_pagerank(links, seeds, rounds=400).items()}


def test_distrust_reaches_far_hosts(spark):
    far = 15
    pages = [(i, f"http://bad.com/de/{i}", "") for i in range(3)] + [(100 + i, f"http://h{i}.net/", f"<a href='http://{'bad.com' if i == 1 else f'h{i - 1}.net'}/x'>") for i in range(1, far + 1)]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[100 + i] == "block" for i in range(1, far + 1))


def test_hosts_of_one_page_are_seeds(spark):
    pages = [(1, "http://one.com/de/1", ""), (2, "http://one.com/x", ""), (3, "http://to.net/", "<a href='http://one.com/x'>"), (4, "http://two.com/fr/1", "<a href='//fine.net/'>"), (5, "http://fine.net/", "<a href='//one.com'>"), (6, "http://two.com/x", "")]
    got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_ranks_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "LIMIT", 3)
    df = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1) for i in range(6)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        urlfilter.propagate(df, spark.createDataFrame([("h0", 1.0)], "node string, seed double"), rounds=None)


def test_hosts_and_paths(spark):
    r = spark.createDataFrame([("x://A.b/c/d?e#f\ng",)], "u string").select(urlfilter.host(F.col("u")).alias("h"), urlfilter.path(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == ("a.b", "/c/d")


def test_words_are_counted_without_a_match_for_each(spark):
    texts = ["", " ", "One two", "-a-", "é'É ß", "A1 b_c\tD", "!?", "x" * 50, "ü", "Σ Σ 9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(decontam.n_words(F.col("t")).alias("n"), F.size(decontam.words(F.col("t"))).cast("long").alias("w"), F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("r")).collect()
    assert all(r.n == r.w == r.r for r in got)
    # a count of matches makes an object of each
    bench = spark.createDataFrame([("1", "one two")], "item_id string, text string")
    report = decontam.report(df.select(F.col("i").cast("long").alias("doc_id"), F.col("t").alias("text")), bench)
    assert "regexp_" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_toxic_rows_go_in_parts_of_few_bytes(spark, monkeypatch):
    from spanlens.llm import toxicity

    largest = []
    rng = random.Random(3)
    rows = [(i, ("hate " if i % 2 else "kind ") * 3 + " ".join(rng.choice("abcdef") for _ in range(4))) for i in range(120)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), *[(1000 + i, "kind word " * 20_000) for i in range(12)]], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit_labelled(docs, labels)

    class Watched:
        def scores(self, texts):
            largest.append(sum(map(len, texts)))
            return model.scores(texts)

    monkeypatch.setattr(toxicity, "fit_labelled", lambda *_: model)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema: run)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda m: type("B", (), {"value": Watched()})())
    run = toxicity.drop_toxic(docs, labels)
    kept = [d for b in run(iter(docs.toArrow().to_batches())) for d in b.column(0).to_pylist()]
    monkeypatch.undo()
    assert max(largest) < 1 << 20 and len(kept) == len(set(kept))
    want = [r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()]
    assert sorted(kept) == sorted(want) and {900, 901} <= set(kept)
