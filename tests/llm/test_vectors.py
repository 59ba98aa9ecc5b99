"""Hard negatives and vector codes against plain loops."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratagraph.llm import codebooks, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, n long, code string, error string, id string, q int, window int, anchor string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "c", "e", "i", 3, 4, "a") for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def some_vectors(seed, n, width=8, ids=None, values=(-0.5, -0.1, 0.0, 0.125, 0.25, 0.5, 1.0)):
    r = random.Random(seed)
    return [((ids or (lambda k: k))(k), [r.choice(values) for _ in range(width)], r.randrange(4)) for k in range(n)]


ODD = [
    (None, [1.0] * 8, 1),
    (500, None, 1),
    (501, [1.0] * 7 + [None], 1),
    (502, [float("nan")] * 8, 1),
    (503, [float("inf")] + [0.0] * 7, 1),
    (504, [1.0] * 8, None),
    (600, [], 2),
    (601, [1.0, 0.5], 2),
    (700, [0.25] * 8, 3),
    (700, [0.25] * 8, 3),
    (700, [0.5] * 8, 3),
]


def brute_negatives(rows, positives=5, negatives=10):
    kept = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and usable(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, (i, v, label) in enumerate(kept):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other) for b, (j, w, other) in enumerate(kept) if b != a)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:negatives]
            out += [(i, j, k, m, -p, -s) for k, (s, m, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())


@pytest.mark.parametrize("spare", [0, 64])
def test_negatives_equal_brute_force(spark, monkeypatch, spare):
    monkeypatch.setattr(hard_negatives, "SPARE", spare)
    # few distinct vectors, so that ties are longer than any window, and ids far apart, so that their digits decide
    rows = some_vectors(1, 400, 4, lambda k: k * 100 if k % 40 == 0 else (k * 7919) % (1 << 40) + 1, (0.25, 0.5)) + ODD
    assert mined(table(spark, rows)) == brute_negatives(rows)


def test_negatives_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = some_vectors(2, 300, ids=lambda k: k * 10)
    want = brute_negatives(rows)
    assert want and mined(table(spark, rows)) == want


def test_copies_each_take_a_rank(spark):
    rows = [(100, [1.0, 0.0], 1)] * 2 + [(1, [1.0, 0.0], 1)] * 3 + [(2, [0.5, 0.0], 2)] * 30 + [(3, [0.75, 0.5], 2), (2, [0.5, 0.25], 2)]
    want = brute_negatives(rows)
    assert len(want) == 80 and mined(table(spark, rows)) == want


def test_large_components_and_ids(spark):
    rows = [(0, [3e4, -3e4], 1), (-(1 << 62), [2e4, -3e4], 1), (1 << 62, [1e4, -2e4], 2), (5, [1.0, -2e4], 2), (6, [3e38, 0.0], 3)]
    cut = [(i, [max(-32768.0, min(32768.0, x)) for x in v], label) for i, v, label in rows]
    assert mined(table(spark, rows)) == brute_negatives(cut)


def test_no_anchors_and_empty_tables(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(1, [1.0], 1), (2, None, None)])) == []
    assert mined(table(spark, [(100, [1.0], 1)])) == []


def brute_codes(rows, entries=256, rounds=4):
    width = -(-max((len(v) for _, v, _ in rows if usable(v)), default=1) // 4) * 4 or 4
    kept = [(i, [max(-(1 << 23), min(1 << 23, math.floor(1024 * x))) for x in v] + [0] * (width - len(v)), label) for i, v, label in rows if usable(v)]
    size = width // 4
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * size : (p + 1) * size] for r in first] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p in range(4):
                x = v[p * size : (p + 1) * size]
                groups[p, near(x, books[p])[1]].append(x)
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for i, v, label in kept:
        found = [near(v[p * size : (p + 1) * size], books[p]) for p in range(4)]
        coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    total = defaultdict(int)
    for _, _, d, label in coded:
        total[label] += d
    return sorted(((i, c, d, total[label], digest) for i, c, d, label in coded), key=repr)


@pytest.mark.parametrize(("rows", "entries"), [(some_vectors(3, 120) + ODD, 256), (some_vectors(4, 300), 16), ([(1, [1.0, 2.0, 3e38], None), (2, [0.5], None), (2, [0.5], 7)], 2), ([(1, [], 1)], 256), ([(1, None, 1)], 256), ([], 256)])
def test_codes_equal_brute_force(spark, rows, entries):
    got = codebooks.compress(table(spark, rows), entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_codes(rows, entries)


def test_many_labels_are_joined_by_key(spark):
    rows = some_vectors(5, 100) + [(900, [0.5] * 8, None)] * 40
    assert sorted((tuple(r) for r in codebooks.compress(table(spark, rows), entries=8, labels=2).collect()), key=repr) == brute_codes(rows, 8)
