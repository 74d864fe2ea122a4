"""Text scalars as Column expressions: normal form, word and n-gram analysers, tags, white space."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's [^\W\d_]: letters, and numbers that are not decimal digits.
_LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: A word keeps an apostrophe only before another letter; digits make words of their own.
WORD = rf"{_LETTER}++(?:'(?={_LETTER}))?+|\p{{Nd}}++"
TAG = "<[A-Z][A-Z0-9-]*>"
#: Fixed order of tag categories; others follow, sorted.
TAG_CATEGORIES = ("LEX", "SYN", "MORPH", "ORTHO", "DISC")


@lru_cache(maxsize=1)
def _maybe_not_nfc() -> str:
    """A class of the characters without which a text is in normal form C: marks, vowels and finals of Hangul, which
    may join what stands before them, and those that are normalised away even alone."""
    alone = [c for c in range(0x340, 0x110000) if not 0xD800 <= c < 0xE000 and not unicodedata.is_normalized("NFC", chr(c))]
    runs: list[list[int]] = []
    for c in alone:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    # nothing below U+0300 is among them, which is told at once
    return r"[\x{300}-\x{10FFFF}&&[\p{M}\x{1161}-\x{1175}\x{11A8}-\x{11C2}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs) + "]]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Normal form C. Only texts that may not be in it are sent to Python."""
    return F.coalesce(_nfc(F.when(F.rlike(c, F.lit(_maybe_not_nfc())), c)), c)


def normalize(c: Column, is_nfc: bool = False) -> Column:
    """NFC (skipped where the caller knows that it holds), the curly apostrophe made straight, lower case."""
    return F.lower(F.replace(c if is_nfc else nfc(c), F.lit("’"), F.lit("'")))


def word_tokenize(c: Column, stopwords: Sequence[str] = (), is_nfc: bool = False) -> Column:
    words = F.regexp_extract_all(normalize(c, is_nfc), F.lit(WORD), F.lit(0))
    return _without(words, stopwords)


def _without(tokens: Column, stopwords: Sequence[str]) -> Column:
    if not stopwords:
        return tokens
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def word_ngrams(words: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """Character n-grams inside each word, by n ascending; a word shorter than n_min stays whole."""
    if not 1 <= n_min <= n_max:
        raise ValueError(f"bad n-gram range: {n_min}..{n_max}")

    def of_size(w: Column):
        return lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))

    def of_word(w: Column) -> Column:
        sizes = F.sequence(F.lit(n_min), F.least(F.lit(n_max), F.length(w)))
        return F.when(F.length(w) < n_min, F.array(w)).otherwise(F.flatten(F.transform(sizes, of_size(w))))

    return F.flatten(F.transform(words, of_word))


def n_word_ngrams(length: Column, n_min: int = 3, n_max: int = 5) -> Column:
    """How many n-grams word_ngrams makes of a word of a length."""
    return F.when(length < n_min, F.lit(1)).otherwise(sum((F.greatest(length - (n - 1), F.lit(0)) for n in range(n_min, n_max + 1)), F.lit(0)))


def char_ngram_tokenize(c: Column, n_min: int = 3, n_max: int = 5, stopwords: Sequence[str] = (), is_nfc: bool = False) -> Column:
    return word_ngrams(word_tokenize(c, stopwords, is_nfc), n_min, n_max)


def get_tokenizer(analyzer: str, **how):
    """Column -> array column of tokens, for analyzer word or char_ngram."""
    if analyzer == "word":
        return lambda c: word_tokenize(c, **how)
    if analyzer == "char_ngram":
        return lambda c: char_ngram_tokenize(c, **how)
    raise ValueError(f"unknown analyzer: {analyzer!r}")


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value of c, which is evaluated once however often body uses it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def joined_ngrams(tokens: Column, n: int = 3) -> Column:
    """The distinct n-grams of all tokens written together, across words; a shorter string is its own only member."""

    def of(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, n))
        return F.when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(every))

    return let(F.array_join(tokens, ""), of)


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays as sets; two empty ones give 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), union))


def n_tokens(c: Column) -> Column:
    """Runs of anything but Unicode white space."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def squash(c: Column, drop_hyphens: bool = False) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\-‐‑]+" if drop_hyphens else r"(?U)\s+", "")


def trim_bounds(body: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The interval without white space at its edges; of white space only, an empty one."""
    piece = F.substring(body, start + 1, end - start)
    lead = F.length(F.regexp_extract(piece, r"(?U)\A\s*", 0))
    trail = F.length(F.regexp_extract(piece, r"(?U)\s*\z", 0))
    return start + lead, F.greatest(end - trail, start + lead)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def extract_tags(c: Column) -> Column:
    """Distinct tags without brackets, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit("<([A-Z][A-Z0-9-]*)>"), F.lit(1)))


def tag_categories(tags: Column) -> Column:
    """What stands before the first hyphen of each tag: the known categories in fixed order, then the others sorted."""
    own = F.array_distinct(F.transform(tags, lambda t: F.substring_index(t, "-", 1)))
    known = F.array(*[F.lit(k) for k in TAG_CATEGORIES])
    return F.concat(F.array_intersect(known, own), F.array_sort(F.array_except(own, known)))


def preview(c: Column, n: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(strip_tags(c), r"(?U)\s+", " ")), 1, n)


def model_slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9.\-]+", "_"), F.lit("_"))


def default_prefixes(model: Column) -> Column:
    """struct(query, passage): prefixes that the e5 family expects; others take none."""
    e5 = F.contains(F.lower(model), F.lit("e5"))
    return F.struct(F.when(e5, "query: ").otherwise("").alias("query"), F.when(e5, "passage: ").otherwise("").alias("passage"))


def quote(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def fold(items: Column, state: dict[str, Column], kind: str, step: Callable[[Column, Column], tuple[dict[str, Column], Column]], block: int = 128) -> Column:
    """struct of the last state, and out (array<kind>): step takes the state and an item, and gives the next state and an
    array that out goes on with.

    Output is gathered block by block: n items cost about n * block / 2 copied elements where one array that grows to the
    end costs n * n / 2.
    """

    def pack(of: Column, out: Column) -> Column:
        return F.struct(*[of[n].alias(n) for n in state], out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new, more = step(acc, x)
        return F.struct(*[new[n].alias(n) for n in state], F.concat(acc["out"], more).alias("out"))

    def of_block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, pack(acc, F.array().cast(f"array<{kind}>")), one)
        return let(inner, lambda r: pack(r, F.concat(acc["out"], F.array(r["out"]))))

    def of(every: Column) -> Column:
        count = F.ceil(F.size(every) / block).cast("int")
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(places, lambda i: F.slice(every, i * block + 1, F.lit(block)))
        start = F.struct(*[c.alias(n) for n, c in state.items()], F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, start, of_block, lambda acc: pack(acc, F.flatten(acc["out"])))

    return let(items, of)


def running(lengths: Column) -> Column:
    """Before each of an array of lengths, the sum of those ahead of it."""
    return fold(lengths, {"at": F.lit(0)}, "int", lambda acc, n: ({"at": acc["at"] + n}, F.array(acc["at"])))["out"]


def pieces_between(text: Column, starts: Column, ends: Column, block: int = 4096) -> Column:
    """text[start:end] for each two of the arrays starts and ends; null if either is. The text is cut into blocks once,
    so that a piece far in costs no walk from the text's beginning."""

    def of(x: Column) -> Column:
        def one(a: Column, b: Column) -> Column:
            first = F.floor(a / block).cast("int")
            n = F.greatest(F.floor((b - 1) / block).cast("int") - first + 1, F.lit(0))
            return F.substring(F.array_join(F.slice(x["blocks"], first + 1, n), ""), a - first * block + 1, F.greatest(b - a, F.lit(0)))

        return F.zip_with(x["starts"], x["ends"], one)

    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(starts.isNotNull() & ends.isNotNull(), let(F.struct(cut.alias("blocks"), starts.alias("starts"), ends.alias("ends")), of))


def find_all(needle: Column, hay: Column) -> Column:
    """0-based places of needle in hay, overlapping ones too; none for an empty needle.

    A split before each place where the needle follows cuts at all of them, but for one at the start; the lengths of
    the pieces are the distances between them.
    """
    none = F.array().cast("array<int>")

    def of(x: Column) -> Column:
        pieces = F.transform(F.split(x["hay"], F.concat(F.lit("(?="), quote(x["needle"]), F.lit(")")), -1), lambda p: F.length(p))
        found = F.filter(running(pieces), lambda at: (at > 0) | F.startswith(x["hay"], x["needle"]))
        return F.when(F.contains(x["hay"], x["needle"]) & (F.length(x["needle"]) > 0), found)

    return F.coalesce(let(F.struct(needle.alias("needle"), hay.alias("hay")), of), none)


def normalize_rows(v: Column) -> Column:
    """A vector divided by its L2 norm; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
