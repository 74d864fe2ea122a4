"""Greedy word-piece lengths by a linear longest-match automaton, without building the pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .common import texts
from .tokens import _bytes_of, default_path

WORD_START = "Ġ"
_HELD = 128 << 20


class LongestMatch:
    """Counts the pieces of a word that greedy longest match from the left gives.

    The first piece of a word is one of first, later ones of rest; a word that can't be covered counts as one unknown
    piece. The trie holds both vocabularies. When a word can't go on from a node, fail[node] is where matching resumes
    and popped[node] how many pieces are settled by then, as both are known once the trie is; each byte is read once.
    """

    def __init__(self, first: set[bytes], rest: set[bytes]):
        goto: list[dict[int, int]] = [{}, {}]  # nodes 0 and 1: nothing read of a word, and of a later piece
        ends = [False, False]
        depth_order: list[tuple[int, int, int]] = []

        def add(root: int, piece: bytes) -> None:
            at = root
            for b in piece:
                if b not in goto[at]:
                    goto.append({})
                    ends.append(False)
                    goto[at][b] = len(goto) - 1
                at = goto[at][b]
            ends[at] = True

        for piece in first:
            add(0, piece)
        for piece in rest:
            add(1, piece)
        fail, popped = [-1] * len(goto), [0] * len(goto)
        layer = [(root, b, node) for root in (0, 1) for b, node in goto[root].items()]
        while layer:  # breadth first: a node's parent is done before it
            depth_order.extend(layer)
            layer = [(node, b, child) for _, _, node in layer for b, child in goto[node].items()]
        for parent, b, node in depth_order:
            if ends[node]:
                fail[node], popped[node] = 1, 1  # the whole string is one piece
                continue
            at, n = fail[parent], popped[parent]
            while at != -1 and b not in goto[at]:
                n += popped[at]
                at = fail[at]
            if at != -1:
                fail[node], popped[node] = goto[at][b], n
        self.goto, self.fail, self.popped = goto, fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of the word; -1 if it can't be covered, 0 if it is empty."""
        goto, fail, popped = self.goto, self.fail, self.popped
        at = n = 0
        for b in word:
            while (to := goto[at].get(b)) is None:
                n += popped[at]
                at = fail[at]
                if at == -1:
                    return -1
            at = to
        while at > 1:
            n += popped[at]
            at = fail[at]
        return n if at == 1 or not word else -1


class Counts(dict):
    """Of words met before; the table is emptied when these hold many bytes."""

    held = 0

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 120
        if self.held > _HELD:
            self.clear()
            self.held = len(word) + 120
        n = self[word] = self.automaton.count(word)
        return n


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """First and later pieces, as bytes, of a byte-level tokenizer file: its entries with and without a leading space."""
    from tokenizers import Tokenizer

    t, stand = Tokenizer.from_file(path), _bytes_of()
    added = {x.content for x in t.get_added_tokens_decoder().values()}
    pieces = [p for p in t.get_vocab(with_added_tokens=True) if p not in added]
    first = {bytes(stand[c] for c in p[1:]) for p in pieces if p.startswith(WORD_START) and len(p) > 1}
    return first, {bytes(stand[c] for c in p) for p in pieces if not p.startswith(WORD_START)}


_COUNTS: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_words, n_tokens, n_unknown.

    Words are the runs of bytes of a text other than ASCII white space; n_tokens sums their pieces, an unknown word
    being one. Null and empty texts have none. Repeated rows come out as often as they come in; other columns are not
    read.
    """
    path = path or default_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTS:
            _COUNTS[path] = Counts(LongestMatch(*vocabulary(path)))
        get = _COUNTS[path].__getitem__
        for batch in batches:
            n_words, n_tokens, unknown = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                each = [get(w) for w in text.split()]
                bad = each.count(-1)
                n_words.append(len(each))
                n_tokens.append(sum(each) + 2 * bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_tokens, unknown)]], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
