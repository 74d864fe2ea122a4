import zlib

import numpy as np
import pytest

from spanlens.llm import packing, tokencount, tokenstore
from spanlens.llm.tokens import default_path, encoder

TEXTS = [(1, "The quick brown fox. " * 120), (2, ""), (3, None), (4, "Éàü " * 700), (5, "a"), (5, "a"), (None, "null id"), (9, "x" * 5000), (10, "<|endoftext|> \x1c odd")] + [(20 + i, f"doc {i} " * (i % 37)) for i in range(90)]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, "en", 7, "k") for d, t in rows], "doc_id long, text string, lang string, start int, key string").repartition(2)


def ids_of(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_pieces(rows, want, most=1024, segments=256):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(r.length for r in pieces) <= most and len(pieces) <= segments
    for (doc, n), pieces in by_doc.items():
        copies = [ids for d, ids in want if d == doc and len(ids) == n]
        assert copies
        cover = sorted((r.start, r.length) for r in pieces)
        assert sum(length for _, length in cover) == n * len(copies)
        assert all(r.ids_crc32 == crc(copies[0][r.start : r.start + r.length]) for r in pieces)
    return by_sequence


def test_packing_keeps_each_id_once_with_little_padding(spark):
    rows = packing.pack_documents(docs(spark)).collect()
    want = [(d, ids_of(t)) for d, t in TEXTS]
    sequences = check_pieces(rows, want)
    total = sum(len(i) for _, i in want)
    assert sum(r.length for r in rows) == total
    assert len(sequences) <= total // 1024 + 3  # one tail for each of two partitions


def test_three_limits_at_once(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} of {c} " * (1 + (c * t) % 9)) for c in range(60) for t in range(4)] + [(99, 0, None, None), (98, 0, "assistant", "y " * 3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    rows = packing.pack_conversations(df, max_tokens=256, max_segments=5, max_loss=90).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in p) <= 256 and len(p) <= 5 and sum(r.loss_tokens for r in p) <= 90 for p in by.values())
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert all(lengths[r.doc_id] == r.doc_tokens for r in rows) and len(lengths) == 62


def test_whole_examples_stay_whole():
    packer = packing.Packer(10, 3, 6, cut=False, pool=4)
    rng = np.random.default_rng(0)
    made, given = [], 0
    for i in range(50):
        n = int(rng.integers(1, 7))
        given += n
        made += list(packer.add(i, np.arange(n, dtype=np.uint32), (rng.random(n) < 0.5).astype(np.int64)))
    made += list(packer.rest())
    assert sum(len(p[2]) for s in made for p in s) == given and sorted(p[0] for s in made for p in s) == list(range(50))
    with pytest.raises(ValueError):
        list(packer.add(1, np.zeros(11, np.uint32), np.zeros(11, np.int64)))


def test_encoder_is_the_library(spark):
    e = encoder(default_path())
    for _, t in [*TEXTS, (0, "don't  stop\n\n\t½ — “q” 12 345"), (0, "日本 語\u2028x"), (0, "x\u200bÀ ſt")]:
        assert e.ids(t or "").tolist() == ids_of(t)[:-1]


def test_store_round_trip(spark):
    rows = sorted((tuple(r) for r in tokenstore.store_and_read(docs(spark), spark).collect()), key=lambda r: r[1])
    order = sorted(((-1 if d is None else d, t or "") for d, t in TEXTS), key=lambda x: x[0])
    at, want = 0, []
    for d, t in order:
        ids = ids_of(t)
        want.append((None if d == -1 else d, at, len(ids), crc(ids)))
        at += len(ids)
    assert rows == want
    assert tokenstore.store_and_read(docs(spark, []), spark).collect() == []


def test_one_document_of_a_shard(tmp_path):
    import io

    import pyarrow as pa

    out = io.BytesIO()
    w = tokenstore.ShardWriter(out, b"", 2)
    data = {None: np.array([7, 0]), 3: np.arange(500), 8: np.array([0])}
    for d, ids in data.items():
        w.add(d, ids)
    w.close()
    r = tokenstore.ShardReader(pa.BufferReader(out.getvalue()), b"")
    assert r.find(3).tolist() == list(range(500)) and r.find(8).tolist() == [0] and r.find(4) is None and r.ids(0).tolist() == [7, 0]
    with pytest.raises(ValueError):
        tokenstore.ShardReader(pa.BufferReader(out.getvalue()), b"other")


def greedy(word, first, rest):
    n, at = 0, 0
    while at < len(word):
        vocab = rest if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_is_greedy_longest_match():
    import itertools

    first, rest = {b"a", b"ab", b"abcd", b"b"}, {b"a", b"bc", b"c", b"cab", b"bcab", b"ca"}
    auto = tokencount.LongestMatch(first, rest)
    for n in range(8):
        for w in itertools.product(b"abcd", repeat=n):
            assert auto.count(bytes(w)) == greedy(bytes(w), first, rest), bytes(w)


def test_token_counts(spark):
    first, rest = tokencount.vocabulary(default_path())
    got = sorted((tuple(r) for r in tokencount.count_tokens(docs(spark)).collect()), key=str)
    want = []
    for d, t in TEXTS:
        each = [greedy(w, first, rest) for w in (t or "").encode().split()]
        want.append((d, len(each), sum(1 if n < 0 else n for n in each), each.count(-1)))
    assert got == sorted(want, key=str)
