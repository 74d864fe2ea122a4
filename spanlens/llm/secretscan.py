"""Secret scans by a trigram inverted index, in DataFrame operations only.

A Boolean query over trigrams is derived from each rule's pattern on the driver. The index holds postings (trigram,
document) for the trigrams that queries name; a rule's candidates come from intersecting and uniting these, and only
they are searched with its pattern. A rule without a mandatory trigram searches every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, let, pieces_between, running
from .common import discard, lower_ascii, materialise, small, texts

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; one is kept if group has at least least characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, then those that this scan adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # within a run of one class of characters a pattern with its least length finds the same matches
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
_MOST = 16


# A query is True (all documents), a trigram, or ("and" | "or", frozenset of queries).


def _all_of(parts) -> object:
    out = frozenset().union(*[p[1] if isinstance(p, tuple) and p[0] == "and" else {p} for p in parts if p is not True])
    return True if not out else next(iter(out)) if len(out) == 1 else ("and", out)


def _any_of(parts) -> object:
    parts = list(parts)
    if not parts or any(p is True for p in parts):
        return True
    out = frozenset(parts)
    return next(iter(out)) if len(out) == 1 else ("or", out)


def _of_string(s: str) -> object:
    return _all_of(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> object:
    """What trigrams a lower-cased text must hold for the pattern to match in it: a necessary condition."""

    def chars(items) -> set[str] | None:
        out: set[str] = set()
        for op, value in items:
            if op is sre.LITERAL:
                out.add(chr(value).lower())
            elif op is sre.RANGE and value[1] - value[0] < _MOST:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None

    def walk(nodes) -> tuple[set[str] | None, object]:
        """The strings that it can match, if these are few; and what any match needs."""
        needs: list[object] = []
        run: set[str] | None = {""}
        unbroken = True

        def flush() -> None:
            nonlocal run, unbroken
            needs.append(_any_of(_of_string(s) for s in run))
            run, unbroken = {""}, False

        for op, value in nodes:
            got: set[str] | None = None
            if op is sre.LITERAL:
                got = {chr(value).lower()}
            elif op is sre.IN:
                got = chars(value)
            elif op is sre.SUBPATTERN:
                got, need = walk(value[-1])
                needs.append(need)
            elif op is sre.BRANCH:
                each = [walk(x) for x in value[1]]
                if all(s is not None for s, _ in each):
                    got = set().union(*[s for s, _ in each])
                needs.append(_any_of(n for _, n in each))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                low, high, inner = value
                strings, need = walk(inner)
                if low:
                    needs.append(need)
                if strings is not None and high != sre.MAXREPEAT and high <= 5:
                    got = set()
                    for k in range(low, high + 1):
                        power = {""}
                        for _ in range(k):
                            power = {a + b for a in power for b in strings}
                        got |= power
                elif strings is not None and low:
                    got = None
                    power = {""}
                    for _ in range(min(low, 5)):
                        power = {a + b for a in power for b in strings}
                    if len(power) <= _MOST and len(run) * len(power) <= _MOST:
                        run = {a + b for a in run for b in power}
            elif op is sre.AT:
                continue
            if got is None or len(got) * len(run) > _MOST:
                flush()
                if got is not None and len(got) <= _MOST:
                    run = got
            else:
                run = {a + b for a in run for b in got}
        last = _any_of(_of_string(s) for s in run)
        return (run if unbroken else None), _all_of([*needs, last])

    return walk(sre_parse.parse(re.sub(r"^\(\?i\)", "", pattern)))[1]


def grams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*[grams(q) for q in query[1]])


def holds(query: object, mask: Column, bit: dict[str, int]) -> Column:
    """Whether a document whose postings make up mask satisfies the query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return mask.bitwiseAND(F.lit(1 << bit[query])) != 0
    parts = [holds(q, mask, bit) for q in sorted(query[1], key=str)]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def postings(docs: DataFrame, needed: list[str]) -> DataFrame:
    """gram (place in needed), doc_id, tie: the documents whose lower-cased text holds a trigram."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), lower_ascii(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(needed)]))
    return rows.select("doc_id", "tie", F.explode(found).alias("gram"))


def spans(text: Column, rule: Rule) -> Column:
    """array of struct(start, end) of the rule's matches, in code points: gaps between matches and matches alternate, so
    their summed lengths are the offsets."""
    p = F.lit(rule.pattern)

    def length(x: Column) -> Column:
        return F.length(x)

    def of(m: Column) -> Column:
        both = F.zip_with(m["gaps"], m["hits"], lambda gap, hit: gap + F.coalesce(hit, F.lit(0)))
        ends = F.zip_with(running(both), both, lambda at, n: at + n)
        found = F.transform(F.arrays_zip(ends.alias("end"), m["hits"].alias("hit"), m["parts"].alias("part")), lambda x: F.struct((x["end"] - x["hit"]).alias("start"), x["end"].alias("end"), x["part"].alias("part")))
        return F.transform(F.filter(found, lambda x: x["part"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    lengths = F.struct(F.transform(F.split(text, rule.pattern, -1), length).alias("gaps"), F.transform(F.regexp_extract_all(text, p, F.lit(0)), length).alias("hits"), F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), length).alias("parts"))
    return F.get(F.transform(F.array(lengths), of), F.lit(0))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """of_id, of_tie (a hash of the text) and rule_i for each rule with a mandatory trigram: the documents, by the index,
    that at least one of these rules may match in. A written table."""
    queries = [trigram_query(r.pattern) for r in rules]
    needed = sorted(set().union(*[grams(q) for q in queries]))
    if len(needed) > 62:
        raise ValueError("too many trigrams for one mask")
    bit = {g: i for i, g in enumerate(needed)}
    index = materialise(postings(docs, needed))
    mask = index.groupBy("doc_id", "tie").agg(F.bit_or(F.expr("shiftleft(1L, gram)")).alias("mask"))
    wanted = [i for i, q in enumerate(queries) if q is not True]
    flags = mask.select(F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie"), *[holds(queries[i], F.col("mask"), bit).alias(f"rule_{i}") for i in wanted])
    flags = materialise(flags.where(reduce(lambda a, b: a | b, [F.col(f"rule_{i}") for i in wanted])) if wanted else flags.limit(0))
    discard(index)
    return flags


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, text (null: empty), own, a struct of the columns named by keep
    (null for none), and found, an array of struct(start, rank, kind, end) sorted by start, then by the order of the rules.

    Candidates are broadcast if they are few, so that texts stay where they are; else both sides are shuffled.
    """
    flags = small(candidates(docs, rules))
    own = F.struct(*[docs[c] for c in keep]) if keep else F.lit(None)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"), own.alias("own")).withColumn("tie", F.xxhash64("text"))
    rows = rows.join(flags, rows["doc_id"].eqNullSafe(flags["of_id"]) & (rows["tie"] == flags["of_tie"]), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []

    def named(i: int, kind: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))

    for i, rule in enumerate(rules):
        got = F.transform(spans(F.col("text"), rule), named(i, rule.kind))
        candidate = F.col(f"rule_{i}") if f"rule_{i}" in flags.columns else F.lit(True)
        each.append(F.when(candidate & F.rlike("text", F.lit(rule.pattern)), got).otherwise(empty).alias(f"found_{i}"))
    rows = rows.select("doc_id", "text", "own", *each)
    return rows.select("doc_id", "text", "own", F.sort_array(F.concat(*[F.col(f"found_{i}") for i in range(len(rules))])).alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of docs (doc_id, text), repeated ones too: doc_id, counts of the base kinds, base_sha256 (of
    their spans as kind:start:end, comma-joined) and all spans. Null and empty texts have none; other columns are not read."""

    def listed(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(k: str):
        return lambda s: s["kind"] == k

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return scan(docs, rules).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, with their columns, in which each maximal stretch of found spans is replaced by mark, and
    n_chars, if there, counts the new text. A text without a span stays as it is; null becomes empty. Repeated rows stay
    repeated, and columns of any other name pass through."""
    names = docs.columns
    rows = scan(docs, rules, tuple(names))

    def merge(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
        fresh = s["start"] >= acc["end"]
        done = F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end")))
        out = F.when(fresh & (acc["end"] > 0), done).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return {"start": F.when(fresh, s["start"]).otherwise(acc["start"]), "end": F.greatest(acc["end"], s["end"])}, out

    folded = fold(F.col("found"), {"start": F.lit(0), "end": F.lit(0)}, "struct<start:int,end:int>", merge)
    runs = let(folded, lambda r: F.concat(r["out"], F.array(F.struct(r["start"].alias("start"), r["end"].alias("end")))))
    starts = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.length("text")))
    rows = rows.withColumn("runs", F.when(F.size("found") > 0, runs))
    rows = rows.withColumn("new", F.coalesce(F.array_join(pieces_between(F.col("text"), starts, ends), mark), F.col("text")))
    out = {c: F.col(f"own.`{c}`") for c in names} | {"text": F.col("new")}
    if "n_chars" in names:
        out["n_chars"] = F.length("new").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[out[c].alias(c) for c in names])
