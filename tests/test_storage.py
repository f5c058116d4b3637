"""Listings, ranges of one JSON document, whole trees and joined files."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import report
from siftwork.sinks import outputs
from siftwork.sources import coco, files, json_ranges, storage


def put(root, names):
    for name, data in names.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)


def test_listing_is_made_by_tasks(spark, tmp_path):
    names = {f"d{a}/e{b}/f +{c}%.txt": b"x" * c for a in range(4) for b in range(3) for c in range(2)} | {"top.txt": b"", "_hidden/a": b"1", "d0/.b": b"1", "d1/deep/er/z": b"22"}
    put(tmp_path, names)
    want = sorted((n, len(v)) for n, v in names.items() if "_hidden" not in n and "/." not in n)
    for folders in (1, 5, 1000):
        df = storage.listed(spark, str(tmp_path), folders=folders)
        got = sorted((p.partition(str(tmp_path) + "/")[2], n) for p, n in df.select("path", "length").collect())
        assert got == want
        plan = df._jdf.queryExecution().toString()
        assert "f +0" not in plan and "LocalRelation" not in plan and "LocalTableScan" not in plan
    assert df.rdd.getNumPartitions() > 4
    flat = storage.listed(spark, str(tmp_path), recursive=False).collect()
    assert [(r["path"], r["length"]) for r in flat] == [(f"file:{tmp_path}/top.txt", 0)]
    assert flat[0]["modified"] is not None


def test_contents_that_cannot_be_read(spark, tmp_path):
    put(tmp_path, {"a/labels/x.txt": b"0 1 1 1 1\n", "a/labels/y.txt": b"", "a/labels/z.txt": b"\xff\xfe 1"})
    paths = [(f"file:{tmp_path}/a/labels/{n}.txt",) for n in "xy"] + [(f"file:{tmp_path}/gone.txt",), (f"{tmp_path}/a/labels/x.txt",)]
    got = {r["path"]: r["content"] for r in files.contents(spark.createDataFrame(paths, "path string")).collect()}
    assert [got[p[0]] for p in paths] == [b"0 1 1 1 1\n", b"", None, b"0 1 1 1 1\n"]
    lines = files.label_lines(spark, str(tmp_path)).select(files.base_name(F.col("path")), "line_no", "readable").collect()
    assert sorted(map(tuple, lines), key=str) == [("x.txt", 0, True), ("y.txt", None, True), ("z.txt", 0, True)]


def odd_document(seed):
    draw = random.Random(seed)
    bits = ["\\", '"', "{", "}", "[", "]", ",", ":", " ", "é", "字", "a", "\n", "\\\\", '\\"']
    word = lambda: "".join(draw.choice(bits) for _ in range(draw.randint(0, 12)))
    images = [{"id": k, "file_name": word(), "width": draw.randint(0, 9), "height": 3, "extra": {"deep": [{"x": word()}]}} for k in range(40)]
    notes = [{"id": k, "image_id": draw.randint(0, 40), "category_id": draw.randint(0, 3), "bbox": [1.5, 2.0, 3.0, draw.random()], "segmentation": [[1, 2], [3]]} for k in range(60)]
    cats = [{"id": k, "name": word()} for k in range(4)]
    return {"info": {"a": {"b": word()}, "l": [{"c": 1}]}, "images": images, "annotations": notes, 'li"c': [{"id": 9}], "empty": [], "categories": cats, "n": 3}


@pytest.mark.parametrize(("seed", "width", "indent"), [(1, 7, None), (2, 1, None), (3, 64, 2), (4, 1 << 20, None), (5, 331, 1)])
def test_elements_of_one_document(spark, tmp_path, seed, width, indent):
    document = odd_document(seed)
    path = tmp_path / "notes.json"
    path.write_text(json.dumps(document, ensure_ascii=seed % 2 == 0, indent=indent), encoding="utf-8")
    if width == 1:  # a range for each byte is slow: a short document
        document = {k: v[:2] if isinstance(v, list) else v for k, v in document.items()}
        path.write_text(json.dumps(document), encoding="utf-8")
    got = [(r["section"], json.loads(r["element"])) for r in json_ranges.elements(spark, str(path), width).orderBy("at").collect()]
    assert got == [(k, x) for k, v in document.items() if isinstance(v, list) for x in v]
    whole = coco.read(spark, str(path), width)
    assert sorted(map(tuple, whole.categories.collect())) == sorted((c["id"], c["name"]) for c in document["categories"])
    assert sorted(r["id"] for r in whole.images.collect()) == sorted(i["id"] for i in document["images"])
    assert {r["id"]: list(r["bbox"]) for r in whole.annotations.collect()} == {n["id"]: n["bbox"] for n in document["annotations"]}


def test_documents_that_are_not_whole(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text("")
    assert json_ranges.elements(spark, str(path)).count() == 0
    for text in ('{"images": [{"id": 1}', '{"images": [{"id": "1}]}', '{"images": [{"id": 1}]}]'):
        path.write_text(text)
        with pytest.raises(ValueError, match="whole JSON"):
            json_ranges.elements(spark, str(path), 5)
    with pytest.raises(FileNotFoundError):
        json_ranges.elements(spark, str(tmp_path / "none.json"))


def test_tree_changes_as_a_whole(spark, tmp_path):
    root = tmp_path / "out"
    first = spark.createDataFrame([("a/x.txt", b"1"), ("b/y.txt", None), ("z", b"")], "name string, content binary")
    outputs.write_tree(first, str(root), "name", "content")
    tree = lambda: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert tree() == {"a/x.txt": b"1", "b/y.txt": b"", "z": b""}
    # a task that fails half-way leaves the old tree, and nothing of the new one beside it
    many = spark.range(200).repartition(4).select(F.concat(F.lit("n/"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 150, F.raise_error(F.lit("broken"))).otherwise(F.lit("v")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        outputs.write_tree(many, str(root), "name", "content")
    assert tree() == {"a/x.txt": b"1", "b/y.txt": b"", "z": b""} and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    with pytest.raises(ValueError, match="exists"):
        outputs.write_tree(first, str(root), "name", "content", policy="refuse")
    outputs.write_tree(first.filter("name = 'z'"), str(root), "name", "content")
    assert tree() == {"z": b""} and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    # a picture that is missing fails the dataset, and the tree stays
    lost = spark.createDataFrame([("train", f"file:{tmp_path}/no.jpg", "s__1.jpg", ["0 1 1 1 1"])], "final_split string, image_path string, output_name string, labels array<string>")
    with pytest.raises(Exception, match="cannot read"):
        outputs.write_dataset(lost, str(root))
    assert tree() == {"z": b""}
    # so do violations that are found while writing
    marked = spark.range(100).repartition(3).select(F.concat(F.lit("m/"), F.col("id").cast("string")).alias("name"), F.lit("v").alias("content"), F.when(F.col("id") % 40 == 1, F.array(F.lit("bad_class"), F.lit("bad_width"))).alias("codes"))
    with pytest.raises(Exception, match="violations: bad_class=3, bad_width=3"):
        outputs.write_tree(marked, str(root), "name", "content", violations="codes")
    assert tree() == {"z": b""} and sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    outputs.write_tree(first.limit(0), str(root), "name", "content")
    assert root.is_dir() and tree() == {}


def manifest_rows(n):
    names = ['a"b', "c,d", "e\nf", "plain", "", None]
    return [(names[k % 6], "train", f"f{k}", k % 2 == 0, f"/p/q/{k}.jpg", f"o{(k * 7919) % 1000:04d}.jpg", "valid", "s" * 4, "d", k, 3) for k in range(n)]


@pytest.mark.parametrize(("variant", "start", "lines", "image", "flag"), [("plain", b"source,", b"\n", "0.jpg", "true"), ("windows", b"source,", b"\r\n", "/p/q/0.jpg", "True"), ("marked", b"\xef\xbb\xbfsource,", b"\r\n", "/p/q/0.jpg", "True")])
def test_one_manifest_file(spark, tmp_path, variant, start, lines, image, flag):
    schema = "source string, source_split string, family_id string, is_negative boolean, source_image string, output_name string, final_split string, sha256 string, dhash string, width int, height int"
    df = spark.createDataFrame(manifest_rows(300), schema)
    path = tmp_path / "m.csv"
    size = outputs.write_manifest(df.repartition(7), str(path), variant)
    data = path.read_bytes()
    assert len(data) == size and data.startswith(start) and data.endswith(lines) and (b"\r" in data) == (variant != "plain")
    read = list(csv.DictReader(data.decode("utf-8-sig").splitlines(keepends=True)))
    want = sorted(manifest_rows(300), key=lambda r: r[5])
    assert [r["output_name"] for r in read] == [w[5] for w in want] and [r["source"] for r in read] == [(w[0] or "").replace("\n", "\n") for w in want]
    first = next(r for r in read if r["output_name"] == "o0000.jpg")
    assert first["source_image"] == image and first["is_negative"] == flag
    outputs.write_manifest(df.repartition(2), str(path), variant)
    assert path.read_bytes() == data and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["m.csv"]
    outputs.write_manifest(df.limit(0), str(path), variant)
    assert path.read_bytes() == start[:-7] + ",".join(outputs.MANIFEST).encode() + lines


def test_class_counts_keep_their_parsing_in_one_place(spark):
    from siftwork.functions import labels

    df = spark.createDataFrame([("0 .5 .5 .1 .1",), ("1 0 0 1 0 1 1",), ("x",), (None,)], "line string")
    parsed = labels.parsed(df, "line", "p", 3)
    counts = report.zero_filled(report.class_counts(parsed, "p"), "class_id", [0, 1, 2], "lines")
    assert {r[0]: r[1] for r in counts.collect()} == {0: 1, 1: 1, 2: 0}
    assert len(counts._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_archive_members_by_their_ranges(spark, tmp_path):
    import zipfile

    big = bytes(random.Random(1).randbytes(300_000)) * 8
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("labels/", "")
        z.writestr("labels/é.txt", b"\xff1")
        z.writestr("big.bin", big)
        z.writestr(zipfile.ZipInfo("stored.txt"), b"plain" * 9)
        z.writestr("packed.txt", b"x" * 1000, zipfile.ZIP_BZIP2)
    whole = (tmp_path / "a.zip").read_bytes()
    at = whole.find(b"plainplain")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "B.ZIP").write_bytes(b"before" + whole[:at] + b"PLAIN" + whole[at + 5 :])  # behind other bytes, one member damaged
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    got = {(r["archive"].rpartition("/")[2], r["member"]): r["content"] for r in files.archive_members(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.zip", "labels/é.txt"): b"\xff1", ("a.zip", "big.bin"): big, ("a.zip", "stored.txt"): b"plain" * 9, ("a.zip", "packed.txt"): None,
        ("B.ZIP", "labels/é.txt"): b"\xff1", ("B.ZIP", "big.bin"): big, ("B.ZIP", "stored.txt"): None, ("B.ZIP", "packed.txt"): None,
    }
    sizes = files.archive_directory(spark, str(tmp_path)).filter("member = 'big.bin'").select("size").collect()
    assert [r[0] for r in sizes] == [len(big)] * 2


def test_inventory_of_runs(spark, tmp_path):
    import os

    from siftwork.sources import runs

    put(tmp_path, {
        "a/results.csv": b"\xef\xbb\xbf epoch , m(B)\r\n1, 0.5 \r\n\r\n2,nan\r\n3,0.5\r\n4,x,9,9\r\n5\r\n",
        "a/args.yaml": b"k: 1",
        "b/x/results.csv": b"m,epoch\n0.25,7\n",
        "b/x/weights/best.pt": b"w",
        "c/weights/last.pt": b"w",
        "d/args.yaml": b"no run",
        "e/results.csv": b"",
        "f/results.csv": b"\xff\xfe\x00",
        "g/Weights/best.pt": b"w",
        "g/args.yaml": b"k: 1",
        "h/results.csv": b"other,epoch\n1,2\n",
    })
    for k, name in enumerate(["a/results.csv", "b/x/results.csv", "c/weights/last.pt", "e/results.csv", "f/results.csv", "g/args.yaml", "h/results.csv", "b/x/weights/best.pt"]):
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    os.utime(tmp_path / "a/args.yaml", (999, 999))
    got = runs.inventory(spark, str(tmp_path), ["m(B)", "m"], {"o": ["other"]}).collect()
    rows = [(r["run"].partition(str(tmp_path) + "/")[2], r["has_results"], r["has_best"], r["has_last"], r["n_epochs"], r["epoch"], r["best"], r["last_value"], r["o"]) for r in got]
    assert rows == [
        ("b/x", True, True, False, 1, "7", 0.25, 0.25, None), ("h", True, False, False, 1, None, None, None, None), ("g", False, False, False, 0, None, None, None, None),
        ("f", True, False, False, 0, None, None, None, None), ("e", True, False, False, 0, None, None, None, None), ("c", False, False, True, 0, None, None, None, None),
        ("a", True, False, False, 5, "1", 0.5, None, None),
    ]
    assert runs.inventory(spark, str(tmp_path / "none"), ["m"]).count() == 0
    empty = tmp_path / "e/results.csv"
    with pytest.warns(UserWarning, match="is empty"):
        assert runs.results(spark, str(empty)).count() == 0
