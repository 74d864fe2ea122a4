import hashlib
import random

import numpy as np

from spanlens.llm import suffixdedup
from spanlens.llm.suffixsort import Suffixes


def brute(rows, length):
    first = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if doc is not None and first[b[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in suffixdedup.deduplicate(df, **how).collect()), key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(4, 40))) for _ in range(8)]
    out = []
    for doc in range(n):
        parts = [rng.choice(shared)[rng.randint(0, 9) :] if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 7))]
        out.append((doc * 3, " ".join(parts)))
    return out


def test_matches_brute_force(spark):
    rows = [*texts(1), (7, None), (8, ""), (9, "a" * 300), (10, "a" * 49), (11, "b" + "a" * 120 + "b"), (None, "a" * 80), (12, "ab" * 90), (13, "ba" * 60)]
    assert run(spark, rows) == brute(rows, 50)


def test_copies_and_repeated_rows(spark):
    one = texts(2, 4)
    rows = [*one, *one, *[(500 + i, one[0][1]) for i in range(30)], (7, one[1][1]), (7, one[2][1]), (7, one[2][1])]
    assert run(spark, rows) == brute(rows, 50)


def test_small_batches_give_the_same(spark, monkeypatch):
    rows = texts(3)
    monkeypatch.setattr(suffixdedup, "_BUCKET", 2000)
    assert run(spark, rows, length=20, k=8) == brute(rows, 20)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_suffix_sort_is_the_order_of_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, (40, 60), dtype=np.uint8)
    data[20:] = data[:20]
    row, at = (a.ravel() for a in np.meshgrid(np.arange(40), np.arange(30), indexing="ij"))
    group = np.sort(rng.integers(0, 7, len(row)))
    sub = Suffixes(data, 30)
    order, number = sub.classes(group, row, at)
    keys = [(int(group[i]), data[row[i], at[i] : at[i] + 30].tobytes()) for i in order]
    assert keys == sorted(keys)
    assert [a == b for a, b in zip(keys, keys[1:], strict=False)] == [a == b for a, b in zip(number, number[1:], strict=False)]
    assert (sub.sort(group, row, at) == order).all()


def test_collisions_are_told_apart(monkeypatch):
    data = np.frombuffer(b"abcdabcxabcd", np.uint8).reshape(3, 4)
    sub = Suffixes(data, 4)
    monkeypatch.setattr(sub, "common", lambda r1, a1, r2, a2: np.full(len(r1), 4))
    order, number = sub.classes(np.zeros(3, int), np.arange(3), np.zeros(3, int))
    by = dict(zip(order.tolist(), number.tolist(), strict=True))
    assert by[0] == by[2] != by[1]
