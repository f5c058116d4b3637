"""Literal cases of label parsing, boxes and keys."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import keys, labels


def parse(spark, line, nc=None, **options):
    df = spark.createDataFrame([(line,)], "line string")
    return df.select(labels.parse_line(F.col("line"), nc, **options).alias("p")).first()["p"]


def test_box_line(spark):
    p = parse(spark, "3 0.625 0.375 1 0.125", 4)
    assert (p["class_id"], p["x"], p["y"], p["w"], p["h"], p["error"]) == (3, 0.625, 0.375, 1.0, 0.125, None)


@pytest.mark.parametrize(
    ("line", "error"),
    [
        ("7 0.25 0.75 0.125 0.5", "class"),
        ("-1 0.25 0.75 0.125 0.5", "class"),
        ("3 0.25 0.75 0.125 -0.0", "size"),
        ("3 0.25 0.75 1.0001 0.5", "size"),
        ("3 0.25 -0.001 0.125 0.5", "coordinate"),
        ("3 0.25 0.75", "tokens"),
        ("3 0.25 0.75 0.125 0.5 0.5", "tokens"),
        ("2.25 0.25 0.75 0.125 0.5", "class"),
        ("1 nan 0.5 0.2 0.2", "coordinate"),
        ("1 1d 0.5 0.2 0.2", "coordinate"),
        ("", "tokens"),
        (None, "tokens"),
    ],
)
def test_bad_lines(spark, line, error):
    assert parse(spark, line, 4, polygons=False)["error"] == error


def test_polygon(spark):
    p = parse(spark, "2 0.5 0 1 0.25 0.75 0.75 0.25 0.5", 3)
    assert (p["kind"], p["class_id"], p["n_points"]) == ("polygon", 2, 4)
    assert [p[k] for k in "xywh"] == [0.625, 0.375, 0.75, 0.75]
    assert parse(spark, "2 0.5 0 1 0.25 0.75 0.75 0.25", 3)["error"] == "tokens"
    assert parse(spark, "2 0.5 0 0.5 0.25 0.5 0.75", 3)["error"] == "extent"


LINES = [
    None, "", "  \t ", "1", "1 0.5 0.5 0.5 0.5", "  1\t0.5  0.5 0.5 0.5 ", "1 0 1 1 1", "1 0.5 0.5 0.5 0", "1 1.5 0.5 0.5 0.5", "x 0.5 0.5 0.5 0.5",
    "1 1d 0.5 0.5 0.5", "1 nan 0.5 0.5 0.5", "1 1e999 0.5 0.5 0.5", "1.0 .5 5e-1 +0.5 0.5", "1.9 0.5 0.5 0.5 0.5", "99999999999 0.5 0.5 0.5 0.5",
    "5 0.5 0.5 0.5 0.5", "1 0.1 0.2 0.3 0.2 0.3 0.4", "1 0.1 0.2 0.3 0.2 0.3 0.4 0.1", "1 0.1 0.2 0.3 0.2 0.3 1.4", "1 0.1 0.2 0.1 0.3 0.1 0.4", "1 0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8",
]


@pytest.mark.parametrize("mode", labels.CLASS_MODES)
@pytest.mark.parametrize("polygons", [True, False])
def test_lines_read_as_columns_or_at_once_are_the_same(spark, mode, polygons):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string")
    both = labels.parsed(df, "line", "a", 4, mode, polygons).withColumn("b", labels.parse_line(F.col("line"), 4, mode, polygons))
    assert both.columns == ["i", "line", "a", "b"]
    for r in both.collect():
        assert r["a"] == r["b"], r["line"]


def test_class_modes(spark):
    df = spark.createDataFrame([("2.0",), ("1.7",), ("3",), ("x",)], "t string")
    got = df.select(*[labels.class_id(F.col("t"), mode=m).alias(m) for m in labels.CLASS_MODES]).collect()
    assert [tuple(r) for r in got] == [(2, None, 2), (None, None, 1), (3, 3, 3), (None, None, None)]


def test_pixel_box(spark):
    args = [F.lit(float(v)) for v in (8, 6, 32, 12)]
    ok = spark.range(1).select(labels.pixel_box(*args, F.lit(64), F.lit(48)).alias("b"), labels.pixel_box(*args, F.lit(0), F.lit(48)).alias("n")).first()
    assert list(ok["b"]) == [0.375, 0.25, 0.5, 0.25]
    assert ok["n"] is None


def test_fixed8_rounds_the_exact_value(spark):
    df = spark.createDataFrame([(0.123456785,), (None,)], "v double")
    assert [r[0] for r in df.select(labels.fixed8(F.col("v"))).collect()] == ["0.12345678", None]


@pytest.mark.parametrize(
    ("path", "mode", "family"),
    [
        ("in/Oak leaf.rf.77.x.jpg", "marker_and_augment", "s:Oak leaf"),
        ("oak-AUG3.webp", "marker_and_augment", "s:oak"),
        ("oak_augmented_3_aug4.bmp", "marker_and_augment", "s:oak_augmented_3"),
        ("oak_august.bmp", "marker_and_augment", "s:oak_august"),
        ("A.rf.b.rf.c.jpg", "marker_and_augment", "s:A"),
        ("A.rf.b.rf.c.jpg", "marker_and_augment_lower", "s:a"),
        ("A.rf.b.rf.c.jpg", "last_marker", "s:A.rf.b"),
        ("A.jpg", "name_lower", "s:a.jpg"),
    ],
)
def test_families(spark, path, mode, family):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(keys.family(F.col("p"), F.lit("s"), mode)).first()[0] == family


def test_dhash_has_all_bits(spark):
    up, down = list(range(72)), list(range(72, 0, -1))
    df = spark.createDataFrame([(up, down)], "a array<int>, b array<int>")
    got = df.select(keys.dhash(F.col("a")), keys.dhash(F.col("b")), keys.dhash(F.col("a"), rising=True)).first()
    assert list(got) == ["0" * 16, "f" * 16, "f" * 16]
