"""The answer letter in a raw output, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms that count as an answer, in order of precedence.
EXACT = r"(?U)\A[A-Da-d][\s.,;:!)\]]*\z"
ANSWER = r"(?iuU)\banswer\b(?:\s+is)?\s*[:\-–]?\s*\*{0,2}\(?([A-Da-d])\)?\.?\*{0,2}(?![\w'’])"
BOLD = r"(?U)\*\*\s*\(?([A-Da-d])\)?\.?\s*\*\*"
PAREN = r"(?U)\(\s*([A-Da-d])\s*\)"
STANDALONE = r"(?U)(?<![\w'’])([A-D])(?![\w'’])"
# A negation just before a letter rules it out, unless every letter is ruled out.
NEGATED = r"(?<!(?i:net|n[eë]t|not)\s{1,5})(?<!(?i:no)\s{1,6})(?<!(?i:keng)\s{1,4})(?<!(?i:ken)\s{1,5})(?<!(?i:kee[nm])\s{1,4})(?<!(?i:kee)\s{1,5})"


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def parse_letter(raw: Column) -> Column:
    """struct(letter, status): status exact, extracted or unparseable; of several matches of a form the last counts."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\A\s+|\s+\z", "")
    exact = F.when(F.rlike(text, F.lit(EXACT)), F.substring(text, 1, 1))
    free = STANDALONE.replace("(?U)", "(?U)" + NEGATED)
    other = F.coalesce(*[_last(text, p) for p in (ANSWER, BOLD, PAREN, free, STANDALONE)])
    letter = F.upper(F.coalesce(exact, other))
    status = F.when(exact.isNotNull(), "exact").when(other.isNotNull(), "extracted").otherwise("unparseable")
    return F.struct(letter.alias("letter"), status.alias("status"))
