import pytest
from pyspark.sql import functions as F

from spanlens.functions import letters, options, spans, stats, text
from spanlens.plans.evaluation import LETTER_CASES


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'bigint' if isinstance(v, int) else 'array<double>'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], kinds).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("s,want", [("D’Haus ass d'Schoul", ["d'", "haus", "ass", "d'", "schoul"]), ("école 3x", ["école", "3", "x"]), ("rock' n", ["rock", "n"]), ("", []), ("²½ 12", ["²½", "12"])])
def test_words(spark, s, want):
    assert one(spark, text.word_tokenize(F.col("s")), s=s) == want


def test_stopwords_and_ngrams(spark):
    assert one(spark, text.word_tokenize(F.col("s"), stopwords=["de"]), s="de Hond an de Kaz") == ["hond", "an", "kaz"]
    assert one(spark, text.char_ngram_tokenize(F.col("s")), s="Schoul") == ["sch", "cho", "hou", "oul", "scho", "chou", "houl", "schou", "choul"]
    assert one(spark, text.char_ngram_tokenize(F.col("s")), s="ab cde") == ["ab", "cde"]
    assert one(spark, text.joined_ngrams(text.word_tokenize(F.col("s"))), s="ab cd") == ["abc", "bcd"]
    assert one(spark, text.joined_ngrams(text.word_tokenize(F.col("s"))), s="ab") == ["ab"]
    with pytest.raises(ValueError):
        text.word_ngrams(F.col("s"), 4, 3)
    with pytest.raises(ValueError):
        text.get_tokenizer("none")


def test_tags(spark):
    s = "<DISC-A>x <LEX-B>y<LEX-B> <QQ> <b>"
    assert one(spark, text.strip_tags(F.col("s")), s=s) == "x y  <b>"
    assert one(spark, text.extract_tags(F.col("s")), s=s) == ["DISC-A", "LEX-B", "QQ"]
    assert one(spark, text.tag_categories(text.extract_tags(F.col("s"))), s=s) == ["LEX", "DISC", "QQ"]
    assert one(spark, text.preview(F.col("s"), 5), s="<LEX-B> a \n b  cdef") == "a b c"


def test_white_space(spark):
    assert one(spark, text.n_tokens(F.col("s")), s="a b \n c") == 3
    assert one(spark, text.squash(F.col("s"), True), s=" a-b‑c\n d") == "abcd"
    assert one(spark, F.struct(*[c.alias(n) for c, n in zip(text.trim_bounds(F.col("s"), F.lit(1), F.lit(6)), "ab", strict=True)]), s="x  a \n y") == (3, 4)


@pytest.mark.parametrize("needle,hay,want", [("aa", "aaaa", [0, 1, 2]), ("ab", "xabyab", [1, 4]), ("a", "", []), ("", "a", []), ("a.b\\E", "a.b\\E axb a.b\\E", [0, 10]), ("é😀", "😀é😀é😀", [1, 3]), ("aba", "ababa", [0, 2]), ("abc", "abc", [0])])
def test_find_all(spark, needle, hay, want):
    assert one(spark, text.find_all(F.col("n"), F.col("h")), n=needle, h=hay) == want


def test_slugs_vectors_sets(spark):
    assert one(spark, text.model_slug(F.col("s")), s="/org/Model 1.5 (x)") == "org_Model_1.5_x"
    assert one(spark, text.default_prefixes(F.col("s")), s="multilingual-E5") == ("query: ", "passage: ")
    assert one(spark, text.normalize_rows(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, text.normalize_rows(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    e = F.array().cast("array<string>")
    assert one(spark, text.jaccard(e, e)) == 1.0
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


@pytest.mark.parametrize("raw,letter,status", [*LETTER_CASES, (None, None, "unparseable"), ("The answer is: (c)", "C", "extracted"), ("keng A awer **D**", "D", "extracted"), ("not B not C", "C", "extracted"), ("A) or B)", "B", "extracted")])
def test_letters(spark, raw, letter, status):
    assert one(spark, letters.parse_letter(F.col("s")), s=raw) == (letter, status)


def test_options(spark):
    import hashlib
    import random

    q = "text3_q07"
    seed = int.from_bytes(hashlib.sha256(f"{q}|13".encode()).digest()[:8], "big")
    kinds = list(options.KINDS)
    random.Random(seed).shuffle(kinds)
    assert one(spark, options.question_seed(F.col("q")), q=q) == str(seed)
    assert one(spark, options.permutation(F.col("q")), q=q) == kinds
    df = spark.createDataFrame([(kinds,)], "p array<string>")
    gold = "ABCD"[kinds.index("correct")]
    assert df.select(options.gold_letter(F.col("p")).alias("g"), options.semantic_choice(F.col("p"), F.lit(gold.lower())).alias("c"), options.semantic_choice(F.col("p"), F.lit(None).cast("string")).alias("n")).first() == (gold, "correct", None)
    with pytest.raises(Exception, match="invalid option letter"):
        df.select(options.semantic_choice(F.col("p"), F.lit("E"))).collect()
    assert one(spark, options.random_letter(F.col("q"), 5), q=q) == random.Random(f"5:{q}").choice("ABCD")


@pytest.mark.parametrize("a,b,want", [(8, 2, 0.109375), (10, 0, 2 / 1024), (5, 5, 1.0), (0, 0, 1.0), (700, 600, None), (3000, 3200, None)])
def test_mcnemar(spark, a, b, want):
    import math

    got = one(spark, stats.mcnemar_exact(F.col("a"), F.col("b")), a=a, b=b)
    if want is None:
        n, k = a + b, min(a, b)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert got == pytest.approx(want, rel=1e-9)


def test_bootstrap():
    import numpy as np

    x = np.array([1.0] * 30 + [0.0] * 10)
    idx = np.random.default_rng(12345).integers(0, 40, size=(10_000, 40))
    assert stats.bootstrap_ci(x) == pytest.approx(tuple(np.quantile(x[idx].mean(axis=1), [0.025, 0.975])))
    assert stats.bootstrap_ci(np.ones(5)) == (1.0, 1.0) and stats.bootstrap_ci([]) == (None, None)


def test_spans(spark):
    assert one(spark, spans.overlap_chars(F.lit(0), F.lit(10), F.lit(10), F.lit(20))) == 0
    assert one(spark, spans.overlaps(F.lit(0), F.lit(10), F.lit(9), F.lit(20)))
    assert not one(spark, spans.overlaps(F.lit(0), F.lit(10), F.lit(10), F.lit(20)))
    assert not one(spark, spans.resolved(F.lit("unresolved"), F.lit(0), F.lit(1)))
    assert not one(spark, spans.resolved(F.lit("exact"), F.lit(None), F.lit(1)))


def test_characters_that_may_join_are_told_as_before(spark):
    every = spark.range(0x110000).where("id not between 55296 and 57343").withColumn("c", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32"))
    # the class without its first bound, which is there to tell most characters at once
    whole = text._maybe_not_nfc().replace(r"[\x{300}-\x{10FFFF}&&", "", 1)[:-1]
    odd = every.where(F.rlike("c", F.lit(whole)) != F.rlike("c", F.lit(text._maybe_not_nfc())))
    assert odd.count() == 0


def test_words_keep_an_apostrophe_between_letters_only(spark):
    import re

    texts = ["l'eau d' 'a' b''c d'1 1'd x'y'z 12ab ½'e", "a'b'c'", "rock'n'roll", "''", "é'é"]
    old = r"[^\W\d_]+'(?=[^\W\d_])|[^\W\d_]+|\d+"
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.word_tokenize(F.col("t"))).collect()]
    assert got == [re.findall(old, t) for t in texts]
