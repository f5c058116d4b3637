"""Splits that keep linked families together, readiness of a dataset, sources that a class map must know."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import classify, select
from siftwork.sources import scan


def components(pairs):
    """Smallest node by node, of nodes that share keys."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    first = {}
    for n, k in pairs:
        other = first.setdefault(k, n)
        a, b = sorted((root(n), root(other)))
        up[b] = a
    return {n: root(n) for n, _ in pairs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_equal_union_find(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(120), f"k{r.randrange(90)}") for _ in range(150)] + [(200 + k, f"c{k // 2 + (k % 2)}") for k in range(1)]
    pairs += [(300 + k, f"chain{j}") for k in range(40) for j in (k, k + 1)]  # a long chain
    pairs += [(500 + k, "hub") for k in range(60)]
    got = {row["n"]: row["cluster"] for row in select.clusters(spark.createDataFrame(pairs, "n long, k string"), "n", "k").collect()}
    assert got == components(pairs)


def test_pinned_split(spark):
    r = random.Random(7)
    rows = [(f"f{r.randrange(80):02d}", r.choice([None, "valid", "train", None, None, None]), f"a{r.randrange(60)}" if r.random() < 0.3 else None, f"b{r.randrange(60)}" if r.random() < 0.3 else None) for _ in range(200)]
    rows += [(None, None, None, None), (None, "train", "a1", None)]
    df = spark.createDataFrame(rows, "family string, pin string, a string, b string")
    got = {x["family"]: (x["cluster"], x["split"]) for x in select.split_pinned(df, "family", ["a", "b"], "pin", 0.4, 5).collect()}
    assert set(got) == {x[0] for x in rows}
    of = components([(x[0], (i, x[i])) for x in rows for i in (2, 3) if x[0] is not None and x[i] is not None])
    assert all(got[f][0] == of.get(f, f) for f in got)
    sides = {}
    for f, (c, side) in got.items():
        sides.setdefault(c, set()).add(side)
    assert all(len(s) == 1 for s in sides.values())
    pins = {}
    for f, pin, _, _ in rows:
        pins.setdefault(got[f][0], set()).add(pin)
    for c, held in pins.items():
        if "valid" in held:
            assert sides[c] == {"valid"}
        elif "train" in held:
            assert sides[c] == {"train"}
    share = sum(got[x[0]][1] == "valid" for x in rows) / len(rows)
    assert share >= 0.4 - 0.2
    again = {x["family"]: (x["cluster"], x["split"]) for x in select.split_pinned(df.repartition(5), "family", ["b", "a"], "pin", 0.4, 5).collect()}
    assert {f: c for f, (c, _) in again.items()} == {f: c for f, (c, _) in got.items()} and {f: s for f, (_, s) in again.items()} == {f: s for f, (_, s) in got.items()}
    assert select.split_pinned(df.limit(0), "family", ["a"], "pin", 0.4, 5).count() == 0
    lone = spark.createDataFrame([("x", None, None, None)], df.schema)
    assert [tuple(x) for x in select.split_pinned(lone, "family", ["a"], "pin", 0.4, 5).collect()] == [("x", "x", "train")]


def put(root, names):
    for name, text in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def test_preflight(spark, tmp_path):
    put(tmp_path, {
        "data.yaml": "names: x", "train/images/a.jpg": "i", "train/labels/a.txt": "0 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1\n1 0.5 0.5 0.1 0.1",
        "train/images/b.png": "i", "train/labels/b.txt": "",
        "valid/images/c.jpg": "i", "valid/labels/c.txt": "0 0.5 0.5 0.1 0.1\n1 2 0.5 0.1 0.1\n7 0.5 0.5 0.1 0.1\nx 0.5 0.5 0.1 0.1\n0 1", "valid/labels/d.txt": "1 0.5 0.5 0 0.1", "valid/images/e.jpg": "i",
    })
    rows = scan.preflight(spark, str(tmp_path), ["p", "q"])
    found = {(r["split"], r["measure"]): r["n"] for r in rows.collect() if r["n"]}
    assert found == {
        ("train", "images"): 2, ("train", "label_files"): 2, ("train", "empty_labels"): 1, ("train", "annotations"): 3, ("train", "class_0"): 1, ("train", "class_1"): 2,
        ("valid", "images"): 2, ("valid", "label_files"): 2, ("valid", "missing_label_file"): 1, ("valid", "missing_image_file"): 1, ("valid", "annotations"): 1, ("valid", "class_0"): 1,
        ("valid", "absent_class_1"): 1, ("valid", "non_five_token_label"): 1, ("valid", "invalid_label_value"): 1, ("valid", "invalid_class_id"): 1, ("valid", "invalid_x_center"): 1, ("valid", "invalid_width"): 1,
    }
    with pytest.raises(ValueError, match="valid:absent_class_1=1"):
        scan.require_ready(rows)
    scan.require_ready(scan.preflight(spark, str(tmp_path), ["p", "q"], ("train",)))
    assert {tuple(r) for r in scan.preflight(spark, str(tmp_path / "no"), ["p"], ("train",)).collect()} == {("", "missing_description", 1), ("train", "missing_folder_images", 1), ("train", "missing_folder_labels", 1)}
    # label files are read by one scan of the plan
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # one for each split


def test_unknown_source_is_an_error(spark):
    maps = spark.createDataFrame([("s", 1, 0, "target")], "source string, source_class int, target_class int, role string")
    lines = spark.createDataFrame([("s", 1), ("s", 2)], "source string, source_class int")
    done = classify.remap(lines, maps, ["source", "source_class"], source="source").orderBy("source_class").collect()
    assert [(r["target_class"], r["role"]) for r in done] == [(0, "target"), (None, None)]
    for lost in ("t", None):
        with pytest.raises(Exception, match="unknown source"):
            classify.remap(spark.createDataFrame([(lost, 1)], lines.schema), maps, ["source", "source_class"], source="source").collect()
    assert classify.remap(spark.createDataFrame([("t", 1)], lines.schema), maps, ["source", "source_class"]).select(F.col("role")).first()[0] is None


def test_overlaps_from_sketches(spark):
    from siftwork.operators import report

    rows = spark.range(60000).select((F.col("id") % 20000).alias("k"), F.when(F.col("id") < 15000, "a").when(F.col("id") < 32000, "b").otherwise(None).alias("s"))
    halves = [report.key_sketches(rows.filter(f"k % 2 = {h}"), "s", "k") for h in (0, 1)]
    merged = halves[0].unionByName(halves[1]).groupBy("split").agg(F.theta_union_agg("sketch", 12).alias("sketch"))
    sets = {}
    for k, s in rows.collect():
        sets.setdefault(s, set()).add(k)
    for sketches in (report.key_sketches(rows, "s", "k"), merged):
        got = {(r["left"], r["right"]): r for r in report.overlap_estimates(sketches).collect()}
        assert set(got) == {(None, "a"), (None, "b"), ("a", "b")}
        for (a, b), r in got.items():
            assert abs(r["shared_keys"] - len(sets[a] & sets[b])) <= r["bound"] and r["bound"] < 0.06 * len(sets[a] | sets[b])
    few = report.overlap_estimates(report.key_sketches(rows.filter("k < 500"), "s", "k")).collect()
    assert {(r["left"], r["right"]): r["shared_keys"] for r in few} == {(a, b): len({k for k in sets[a] & sets[b] if k < 500}) for a, b in got}
    assert all(r["bound"] == 0 for r in few) and report.overlap_estimates(report.key_sketches(rows.limit(0), "s", "k")).count() == 0
