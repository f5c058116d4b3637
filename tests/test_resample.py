"""Grids of pictures against plain loops."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siftwork.functions import keys, resample
from siftwork.operators import dedup, match


def plain_area(rows, columns, lines):
    """Each cell's exact mean, as a fraction rounded half to even."""
    h, w = len(rows), len(rows[0])
    out = []
    for r in range(lines):
        for c in range(columns):
            total = Fraction(0)
            for y in range(h):
                dy = min(Fraction((r + 1) * h, lines), y + 1) - max(Fraction(r * h, lines), y)
                for x in range(w):
                    dx = min(Fraction((c + 1) * w, columns), x + 1) - max(Fraction(c * w, columns), x)
                    if dx > 0 and dy > 0:
                        total += rows[y][x] * dx * dy
            out.append(round(total / (Fraction(w, columns) * Fraction(h, lines))))
    return out


def plain_windowed(rows, columns, lines):
    def passed(line, cells):
        if len(line) == cells:
            return line
        sums = [0] * cells
        for cell, x, k in resample.windowed_weights(len(line), cells):
            sums[cell] += line[x] * k
        return [max(0, min(255, (s + (1 << 21)) >> 22)) for s in sums]

    across = [passed(list(r), columns) for r in rows]
    down = [passed(list(c), lines) for c in zip(*across)]
    return [down[c][r] for r in range(lines) for c in range(columns)]


def pictures(seed):
    draw = random.Random(seed)
    for w, h in [(9, 8), (1, 1), (3, 2), (9, 40), (30, 8), (17, 23), (64, 48), (18, 16), (100, 3)]:
        yield [[draw.randint(0, 255) for _ in range(w)] for _ in range(h)]
    yield [[200] * 31 for _ in range(29)]
    yield [[0, 255] * 20 for _ in range(20)]


@pytest.mark.parametrize(("kind", "plain"), [("area", plain_area), ("windowed", plain_windowed)])
def test_grids(spark, kind, plain):
    every = list(pictures(3))
    rows = [(i, bytes(v for line in p for v in line), len(p[0]), len(p)) for i, p in enumerate(every)]
    df = spark.createDataFrame(rows, "id int, pixels binary, w int, h int")
    got = {r[0]: r[1] for r in df.select("id", resample.grid(F.col("pixels"), F.col("w"), F.col("h"), kind)).collect()}
    assert got == {i: plain(p, 9, 8) for i, p in enumerate(every)}
    assert got[0] == [v for line in every[0] for v in line] and set(got[len(every) - 2]) == {200}


def test_weights():
    for size in (1, 7, 9, 10, 100, 641):
        for cell in range(9):
            assert abs(sum(k for c, _, k in resample.windowed_weights(size, 9) if c == cell) - (1 << 22)) <= size
            assert sum(k for c, _, k in resample.area_weights(size, 9) if c == cell) == size
    with pytest.raises(ValueError, match="kind"):
        resample.grid(F.lit(b""), F.lit(1), F.lit(1), "other")


def test_unreadable(spark):
    rows = [(1, b"\1\2\3\4", 2, 2), (2, b"\1\2\3", 2, 2), (3, None, 2, 2), (4, b"\1\2", None, 2), (5, b"", 0, 0), (6, b"\1", -1, -1), (7, b"\1\2\3\4", 2, 2)]
    df = spark.createDataFrame(rows, "id int, pixels binary, w int, h int").withColumn("source", F.lit("s"))
    keyed = resample.with_key(df, "k", "pixels", "pixels", "w", "h").select("id", "source", "k.*")
    assert {r["id"] for r in keyed.filter("dhash is null").collect()} == {2, 3, 4, 5, 6}
    reasons = {r["id"]: r["drop_reason"] for r in dedup.exclude_and_deduplicate(keyed, keyed.limit(0), ["source", "id"]).collect()}
    assert reasons == {1: None, 7: "duplicate_exact"} | dict.fromkeys((2, 3, 4, 5, 6), "unreadable")
    found, counts = match.protected_keys(keyed)
    assert found.count() == 1 and tuple(counts.first()) == (7, 5, 1)
    # a protected record that can't be read protects nothing
    assert {r["drop_reason"] for r in dedup.exclude_and_deduplicate(keyed, keyed.filter("dhash is null"), ["source", "id"]).collect()} == {None, "duplicate_exact", "unreadable"}
    assert keyed.select(keys.dhash(F.lit(None).cast("array<int>"))).first()[0] is None
