"""Quality rules as a short-circuit cascade, in DataFrame operations only."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, materialise, texts

SYMBOLS = "#*$%&|<>"

#: Each rule rejects a row for which its condition on the columns of features() holds. No rule looks at another row.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "few_letters": "2 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < word_chars",
    "one_word": "2 * aggregate(words, 0, (n, w) -> n + if(w = words[0], 1, 0)) > n_words",
    "long_word": "exists(words, w -> length(w) > 1000)",
}


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), words (runs of anything but white space), and of the whole text
    n_words, word_chars (code points in words), n_symbols (characters of SYMBOLS), n_lines (lines with a word), n_dup_lines
    (those equal to an earlier one), n_repeat_words (words in 3-word windows found twice or more, the first included).

    To find repeated windows, a row's windows are sorted as long numbers, a hash in the high bits and the place in the
    low ones; neighbours of equal hash are then compared as words, so the count is exact.
    """
    white = WHITE.replace("\\", "\\\\")
    df = texts(docs).select(
        "doc_id", "text", F.array_remove(F.split("text", WHITE), "").alias("words"),
        F.expr("filter(split(text, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    df = df.select(
        "doc_id", "text", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("shiftleft(1L, length(bin(size(words)))) - 1").alias("low"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    keep = ["doc_id", "text", "words", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    df = df.select(*keep, "low", F.expr("sort_array(transform(slice(hashes, 1, greatest(size(hashes) - 2, 0)), (h, i) -> (xxhash64(h, get(hashes, i + 1), get(hashes, i + 2)) & ~low) | i))").alias("keys"))
    df = df.select(*keep, F.expr("filter(keys, (k, j) -> ((k ^ get(keys, j + 1)) & ~low) = 0 or ((k ^ get(keys, j - 1)) & ~low) = 0)").alias("keys"), "low")
    df = df.select(*keep, F.expr("sort_array(transform(keys, k -> struct(array(words[int(k & low)], words[int(k & low) + 1], words[int(k & low) + 2]) as g, int(k & low) as p)))").alias("same"))
    df = df.select(*keep, F.expr("sort_array(transform(filter(same, (s, j) -> s.g = get(same, j + 1).g or s.g = get(same, j - 1).g), s -> s.p))").alias("places"))
    return df.select(*keep, F.expr("aggregate(transform(places, (p, j) -> least(3, coalesce(get(places, j + 1) - p, 3))), 0L, (a, n) -> a + n)").alias("n_repeat_words"))


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def order(docs: DataFrame, rules: dict[str, str] = RULES, sample: int = 500, seconds: float = 0.3) -> list[tuple[str, float, float]]:
    """The rules by rejections per cost, most first, as (name, share rejected, cost), measured over at most sample rows
    of docs, those of the least hashes of doc_id.

    A rule's cost is the time of a job that evaluates it on the sample, repeated until a job without any rule takes
    seconds, less the time of that job: what starting a job takes is not part of it. A rule that rejects none comes last, the
    cheapest of these first. Results of judge() don't depend on this order, only its cost does.
    """
    n = docs.count()
    bits = (1 << 30) - 1
    h = F.xxhash64("doc_id").bitwiseAND(F.lit(bits))
    some = docs.select("doc_id", "text").where(h <= int(min(1.0, 2 * sample / max(n, 1)) * bits)).orderBy(h, F.xxhash64("text")).limit(sample)
    rows = materialise(features(some)).coalesce(1).cache()
    total = max(rows.count(), 1)

    def timed(condition: str, times: int) -> tuple[float, int]:
        # the place in the sequence is part of the condition, so that it is evaluated anew for each repetition
        many = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        test = many.agg(F.count_if(F.expr(f"({condition}) and time > 0")).alias("n"))
        best = []
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            found = test.collect()[0]["n"]
            best.append(time.perf_counter() - began)
        return min(best), found // times

    times, (base, _) = 1, timed("n_words < 0", 1)
    while base < seconds and times < 64:
        times *= 4
        base, _ = timed("n_words < 0", times)
    found = []
    for name, rule in rules.items():
        took, rejected = timed(rule, times)
        found.append((name, rejected / total, max(took - base, 1e-4)))
    rows.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(names: list[str], rules: dict[str, str] = RULES) -> Column:
    """The first rule, in this order, that rejects a row, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.expr(rules[name]), F.lit(name)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row for each row of docs (doc_id, text), repeated ones too: features() without text and words, base_failed, and
    kept, which is false if base_failed or some rule rejects the row. A null text counts as empty, and so fails. Other
    columns are not read; an empty table gives an empty one."""
    names = [name for name, _, _ in order(docs, rules)]
    df = features(docs).withColumn("base_failed", F.expr(BASE_FAILED))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(names, rules).isNull())
    return df.withColumn("kept", kept).drop("text", "words")
