"""The greedy choice of images equals a fold over each group."""

import random

import pytest

from listingloom.operators import distinct

SHAPE = "g bigint, n bigint, h bigint, kept_before string"


def folded(rows):
    kept, out = {}, {}
    for g, n, h, _ in sorted(rows, key=lambda r: r[1]):
        mine = kept.setdefault(g, [])
        out[n] = h is None or all(((x ^ h) & (1 << 64) - 1).bit_count() > 8 for x in mine)
        if out[n] and h is not None:
            mine.append(h)
    return out


@pytest.mark.parametrize("bits", [12, 24, 64])
def test_greedy_choice(spark, bits):
    rng = random.Random(bits)
    rows = []
    for n in range(500):
        h = rng.getrandbits(bits)
        rows.append((rng.choice([None, 1, 2]), n, None if rng.random() < 0.02 else h - (1 << 64) if h >> 63 else h, "x"))
    got = distinct.greedy_distinct(spark.createDataFrame(rows, SHAPE), "g", ["n"], "h").collect()
    assert {r["n"]: r["kept"] for r in got} == folded(rows) and len(got) == 500


def test_a_dense_cluster_makes_no_pairs(spark):
    """All hashes within eight bits of the first: one round, one kept."""
    rows = [(1, 0, 0, "x")] + [(1, n, (1 << n % 60) | (1 << n * 7 % 60), "x") for n in range(1, 600)]
    got = distinct.greedy_distinct(spark.createDataFrame(rows, SHAPE), "g", ["n"], "h")
    assert [r["n"] for r in got.where("kept").collect()] == [0]


def test_no_images(spark):
    assert distinct.greedy_distinct(spark.createDataFrame([], SHAPE), "g", ["n"], "h").count() == 0


@pytest.mark.parametrize("small", [0, 160])
def test_rounds_and_folds_choose_alike(spark, monkeypatch, small):
    monkeypatch.setattr(distinct, "SMALL_GROUP", small)
    rng = random.Random(small)
    rows = [(g, n, rng.getrandbits(20), "x") for n, g in enumerate([None] * 40 + [1] * 250)]
    got = distinct.greedy_distinct(spark.createDataFrame(rows, SHAPE), "g", ["n"], "h").collect()
    assert {r["n"]: r["kept"] for r in got} == folded(rows)
