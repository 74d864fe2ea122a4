"""Chunkers: a text in, chunks with stable code-point offsets out. body[start:end] is always the chunk's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, let, n_tokens, pieces_between, running

# Fixed values of the chunk strategies.
WINDOW, OVERLAP = 150, 0.5
MIN_TOKENS, MAX_TOKENS = 60, 180
BLANK_LINE = r"\n[ \t]*\n+"
CLOSERS = r"""[»«"'„“”’)\]]"""
SENTENCE_END = rf"([.!?…]++{CLOSERS}*+)(?=(?U:\s)|\z|\x{{FDD0}})"
ENDS_AT_EOL = rf"[.!?…]{CLOSERS}*\z"

#: A noncharacter, which no text interchanged as Unicode holds, marks cuts.
_CUT = "\ufdd0"
_SPAN = "struct<start:int,end:int>"

# Each strategy makes array of struct(start, end, text). Texts come from the pieces that a body is cut into, and offsets
# are sums of lengths of pieces, so that nothing is looked for from the body's beginning again.


def _pieces(body: Column, pattern_cut: str, keep: str) -> Column:
    return F.split(F.regexp_replace(body, pattern_cut, keep), _CUT)


def _trim(piece: Column, at: Column) -> Column:
    """struct of what is left of a piece at a place without white space at its edges."""
    lead = F.length(F.regexp_extract(piece, r"(?U)\A\s*", 0))
    kept = F.regexp_replace(piece, r"(?U)\A\s+|\s+\z", "")
    return let(F.struct((at + lead).cast("int").alias("start"), kept.alias("text")), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["text"])).alias("end"), x["text"].alias("text")))


def _trimmed(pieces: Column) -> Column:
    """Pieces that follow each other without gaps, trimmed; those of white space only are left out."""

    def of(p: Column) -> Column:
        placed = F.zip_with(p, running(F.transform(p, lambda x: F.length(x))), _trim)
        return F.filter(placed, lambda s: s["start"] < s["end"])

    return let(pieces, of)


def sentence_spans(body: Column) -> Column:
    """Cuts after sentence-final punctuation and closers before white space or the end, and before blank lines."""
    marked = F.regexp_replace(body, rf"({BLANK_LINE})", f"{_CUT}$1")
    return _trimmed(_pieces(marked, SENTENCE_END, f"$1{_CUT}"))


def blank_line_spans(body: Column) -> Column:
    return _trimmed(_pieces(body, rf"({BLANK_LINE})", f"{_CUT}$1"))


def line_group_spans(text: Column) -> Column:
    """struct(start, end) in a long unit of lines gathered until a line ends a sentence with MIN_TOKENS held, or
    MAX_TOKENS are held: a fold over lines with a state that is reset whenever a group is closed."""
    none = F.lit(None).cast("int")

    def step(acc: Column, line: Column) -> tuple[dict[str, Column], Column]:
        end = acc["at"] + F.length(line)
        blank = ~F.rlike(line, F.lit(r"(?U)\S"))
        opened = F.coalesce(acc["open"], acc["at"])
        held = acc["held"] + n_tokens(line)
        ends = F.rlike(F.regexp_replace(line, r"(?U)\s+\z", ""), F.lit(ENDS_AT_EOL))
        flush = ~blank & ((ends & (held >= MIN_TOKENS)) | (held >= MAX_TOKENS))
        closed = F.when(flush, F.array(F.struct(opened.alias("start"), end.alias("end")))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        state = {"at": end + 1, "open": F.when(blank, acc["open"]).when(flush, none).otherwise(opened), "held": F.when(blank, acc["held"]).when(flush, F.lit(0)).otherwise(held)}
        return state, closed

    def finish(acc: Column) -> Column:
        rest = F.array(F.struct(acc["open"].alias("start"), F.length(text).alias("end")))
        return F.when(acc["open"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], rest))

    return let(fold(F.split(text, "\n"), {"at": F.lit(0), "open": none, "held": F.lit(0)}, _SPAN, step), finish)


def paragraph_spans(body: Column) -> Column:
    def grouped(u: Column) -> Column:
        def of(g: Column) -> Column:
            texts = pieces_between(u["text"], F.transform(g, lambda s: s["start"]), F.transform(g, lambda s: s["end"]))
            return F.filter(F.zip_with(texts, g, lambda t, s: _trim(t, u["start"] + s["start"])), lambda s: s["start"] < s["end"])

        return let(line_group_spans(u["text"]), of)

    return F.flatten(F.transform(blank_line_spans(body), lambda u: F.when(n_tokens(u["text"]) > MAX_TOKENS, grouped(u)).otherwise(F.array(u))))


def token_pieces(body: Column) -> Column:
    """Each token with the white space before it."""
    return F.regexp_extract_all(body, F.lit(r"(?U)\s*\S+"), F.lit(0))


def overlap_spans(body: Column, window: int = WINDOW, overlap: float = OVERLAP) -> Column:
    """Windows of tokens; the first starts at 0 and the last ends with the body. A body without tokens has none."""
    step = max(1, window - int(window * overlap))

    def of(p: Column) -> Column:
        n = F.size(p)
        count = F.when(n <= window, F.lit(1)).otherwise(F.ceil((n - window) / F.lit(float(step))).cast("int") + 1)
        # where windows start: sums of lengths of the steps before
        strides = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.length(F.array_join(F.slice(p, i * step + 1, F.lit(step)), "")))

        def one(at: Column, i: Column) -> Column:
            joined = F.array_join(F.slice(p, i * step + 1, F.lit(window)), "")
            text = F.when(i == 0, joined).otherwise(F.regexp_replace(joined, r"(?U)\A\s+", ""))
            start = at + F.when(i == 0, F.lit(0)).otherwise(F.length(joined) - F.length(text))
            end = F.when(i == count - 1, F.length(body)).otherwise(at + F.length(joined))
            tail = F.when(i == count - 1, F.regexp_extract(body, r"(?U)\s*\z", 0)).otherwise("")
            return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.concat(text, tail).alias("text"), F.least(F.lit(window), n - i * step).alias("n"))

        return F.when(n == 0, F.array().cast("array<struct<start:int,end:int,text:string,n:int>>")).otherwise(F.transform(running(strides), one))

    return let(token_pieces(body), of)


STRATEGIES = {"paragraph": paragraph_spans, "overlap": overlap_spans, "sentence": sentence_spans}


def chunk(texts: DataFrame, strategy: str, **how: object) -> DataFrame:
    """chunk_id, text_id, idx, chunk_text, start_char, end_char, n_tokens of texts (text_id, body)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy!r}")
    rows = texts.select("text_id", F.posexplode(STRATEGIES[strategy](F.col("body"), **how)).alias("idx", "s"))
    # windows know their tokens
    n = F.col("s.n") if strategy == "overlap" else n_tokens(F.col("s.text"))
    name = F.format_string(f"%s_{strategy}_c%03d", F.col("text_id").cast("string"), "idx")
    return rows.select(name.alias("chunk_id"), "text_id", "idx", F.col("s.text").alias("chunk_text"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), n.alias("n_tokens"))


def coverage(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """text_id and gaps: places where the union of a text's chunks leaves part of [0, length) uncovered. A text of
    length 0 has no gap; one without chunks has one."""
    w = Window.partitionBy("text_id").orderBy("start_char", "end_char")
    before = F.coalesce(F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    swept = chunks.withColumn("gap", (F.col("start_char") > before).cast("int")).groupBy("text_id").agg(F.sum("gap").alias("inner_gaps"), F.max("end_char").alias("reach"))
    length = F.length("body")
    return texts.select("text_id", length.alias("n")).join(swept, "text_id", "left").select("text_id", F.when(F.col("n") == 0, F.lit(0)).otherwise(F.coalesce("inner_gaps", F.lit(0)) + (F.coalesce("reach", F.lit(0)) != F.col("n")).cast("int")).cast("long").alias("gaps"))
