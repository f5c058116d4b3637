import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwork.operators import detections
from siftwork.sinks import outputs
from siftwork.sources import coco, config, files, runs, scan


def test_files(spark, tmp_path):
    for name in ("train/images/a.JPG", "train/images/b.png", "train/images/c.txt", "val/images/a.jpeg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    (tmp_path / "train/labels").mkdir()
    (tmp_path / "train/labels/a.txt").write_text("0 0.5 0.5 0.1 0.1\r\n\n 1 0.5 0.5 0.1 0.1 \n")
    (tmp_path / "train/labels/b.txt").write_text("")
    found = files.images(spark, str(tmp_path)).select(files.split_of(F.col("path")).alias("s"), files.stem(F.col("path")).alias("t")).collect()
    assert sorted(map(tuple, found)) == [("train", "a"), ("train", "b"), ("valid", "a")]
    assert files.images(spark, str(tmp_path / "none")).count() == 0
    lines = files.label_lines(spark, str(tmp_path)).select(files.base_name(F.col("path")), "line_no", "line").collect()
    assert sorted(map(tuple, lines), key=str) == [("a.txt", 0, "0 0.5 0.5 0.1 0.1"), ("a.txt", 1, "1 0.5 0.5 0.1 0.1"), ("b.txt", None, None)]
    assert spark.range(1).select(files.label_path(F.lit("/d/train/images/a.b.jpg"))).first()[0] == "/d/train/labels/a.b.txt"


def tree(root, files):
    for name, content in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return str(root)


def test_paired_scan_and_its_errors(spark, tmp_path):
    box = "0 0.5 0.5 0.25 0.25"
    whole = tree(tmp_path / "a", {"train/images/x y.jpg": "i", "train/images/x y.png": "i", "train/labels/x y.txt": box, "test/images/z+1.jpg": "i", "test/labels/z+1.txt": ""})
    source = config.SourcePolicy("s", whole, {0: 2})
    got = {(r["source_split"], files_name(r["image_path"])): (r["labels"], r["is_negative"], r["drop_reason"]) for r in scan.paired_records(spark, source).collect()}
    assert got == {("train", "x y.png"): (["2 0.50000000 0.50000000 0.25000000 0.25000000"], False, None), ("test", "z+1.jpg"): ([], False, "empty_label")}
    keep = scan.paired_records(spark, config.SourcePolicy("s", whole, {0: 2}, preserve_empty=True)).filter("is_negative").collect()
    assert [files_name(r["image_path"]) for r in keep] == ["z+1.jpg"]
    lone = tree(tmp_path / "b", {"train/images/x.jpg": "i", "train/labels/y.txt": box})
    with pytest.raises(ValueError, match="don't pair.*'y'"):
        scan.paired_records(spark, config.SourcePolicy("s", lone, {0: 2}))
    with pytest.raises(ValueError, match="missing folder"):
        scan.paired_records(spark, config.SourcePolicy("s", tree(tmp_path / "c", {"valid/images/x.jpg": "i"}), {0: 2}))
    with pytest.raises(ValueError, match="no split"):
        scan.paired_records(spark, config.SourcePolicy("s", tree(tmp_path / "d", {"other/x.jpg": "i"}), {0: 2}))
    with pytest.raises(ValueError, match="unknown format"):
        scan.audits(spark, [{"name": "s", "format": "voc", "root": whole}])


def files_name(path):
    return path.rpartition("/")[2]


def test_written_dataset_is_read_back(spark, tmp_path):
    root = tree(tmp_path / "in", {"p/a.jpg": "picture a", "q/b.jpg": "picture b"})
    rows = [("train", f"file:{root}/p/a.jpg", "s__1.jpg", ["0 1 1 1 1", "1 1 1 1 1"]), ("valid", f"file:{root}/q/b.jpg", "s__2.jpg", [])]
    df = spark.createDataFrame(rows, "final_split string, image_path string, output_name string, labels array<string>")
    out = tmp_path / "out"
    outputs.write_dataset(df, str(out))
    assert (out / "train/labels/s__1.txt").read_bytes() == b"0 1 1 1 1\n1 1 1 1 1\n" and (out / "valid/labels/s__2.txt").read_bytes() == b""
    assert (out / "train/images/s__1.jpg").read_text() == "picture a" and (out / "valid/images/s__2.jpg").read_text() == "picture b"
    with pytest.raises(ValueError, match="exists"):
        outputs.write_dataset(df, str(out), policy="refuse")
    outputs.write_dataset(df.limit(1), str(out))
    assert sorted(p.name for p in out.rglob("*.txt")) == ["s__1.txt"]
    assert outputs.with_root("path: /old\nnames: x", "/new") == "path: /new\nnames: x\n" and outputs.with_root("names: x", "/n").startswith("path: /n\n")


def test_unreadable_run_table_is_empty(spark, tmp_path):
    with pytest.warns(UserWarning, match="cannot read"):
        assert runs.results(spark, str(tmp_path / "none.csv")).count() == 0


def test_best_of_stem_and_first_by_name(spark):
    df = spark.createDataFrame([("d", "d/a.png"), ("d", "d/a.jpg"), ("d", "d/b.BMP")], "folder string, path string")
    assert {r["stem"]: r["path"] for r in files.best_of_stem(df).collect()} == {"a": "d/a.jpg", "b": "d/b.BMP"}
    other = spark.createDataFrame([("z/x.jpg",), ("a/x.jpg",)], "path string")
    assert [r["path"] for r in files.first_by_name(other).collect()] == ["a/x.jpg"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("labels/a.txt", b"0 \xff")
    got = files.archive_members(spark, str(tmp_path)).select("member", files.decoded(F.col("content")).alias("t")).collect()
    assert [tuple(r) for r in got] == [("labels/a.txt", "0 �")]


def test_coco(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "batch/a.jpg", "width": 100, "height": 100}, {"id": 2, "file_name": "b.jpg", "width": 0, "height": 10}],
        "categories": [{"id": 4, "name": "x"}, {"id": 8, "name": "y"}],
        "annotations": [{"id": k, "image_id": 1 + (k == 3), "category_id": c, "bbox": [10, 20, 40, 20]} for k, c in ((1, 4), (2, 8), (3, 4))],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    c = coco.read(spark, str(tmp_path / "c.json"))
    found = spark.createDataFrame([("/d/batch/a.jpg",)], "path string")
    assert tuple(coco.audit(c, found).first()) == (2, 1, 1, 3, 2)
    assert {r["category_id"]: r["annotations"] for r in coco.category_counts(c).collect()} == {4: 2, 8: 1}
    m = spark.createDataFrame([(4, 0, "target")], "source_class int, target_class int, role string")
    rows = coco.boxes(c, m).orderBy("id").collect()
    assert [r["target_class"] for r in rows] == [0, None, 0]
    assert rows[0]["box"]["w"] == 0.4 and rows[2]["box"] is None


def test_config():
    data = {
        "seed": 26, "valid_fraction": 0.1, "max_negative_fraction": 0.2, "source_priority": ["a"],
        "sources": {"a": {"root": "data/a", "class_map": {"1": 0}, "unsupported_class_ids": [3]}},
    }
    c = config.build_config(config.load_text(json.dumps(data)), "/p")
    assert c.sources["a"].root == "/p/data/a" and c.class_rows() == [("a", 1, 0, "target"), ("a", 3, None, "unsupported")]
    paths = config.split_paths({"train": "../train/images", "val": ["/abs/v"]}, "/root/d", lambda p: p.startswith("/root/d/train"))
    assert paths == {"train": ["/root/d/train/images"], "valid": ["/abs/v"]}


def test_runs(spark, tmp_path):
    (tmp_path / "results.csv").write_text("﻿ epoch , metrics/mAP50(B)\n 1 , 0.5 \n2,nan\n")
    df = runs.results(spark, str(tmp_path / "results.csv"))
    assert df.columns == ["epoch", "metrics/mAP50(B)"]
    assert [r[0] for r in df.select(runs.metric(df, ["none", "metrics/mAP50(B)"])).collect()] == [0.5, None]
    paths = spark.createDataFrame([("r/x/results.csv",), ("r/x/weights/best.pt",), ("r/y/other",)], "path string")
    assert [tuple(r) for r in runs.run_folders(paths).collect()] == [("r/x", ["results.csv", "weights/best.pt"])]


def test_outputs(spark, tmp_path):
    rows = [("s", "train", "f", True, "d/a.jpg", "o", "train", "x", "y", 1, 2)]
    df = spark.createDataFrame(rows, "source string, source_split string, family_id string, is_negative boolean, source_image string, output_name string, final_split string, sha256 string, dhash string, width int, height int")
    assert tuple(outputs.manifest(df).first())[3:5] == ("true", "a.jpg")
    outputs.write_split(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
    part = outputs.report(n=df.groupBy("source").count())
    assert outputs.write_json(part, str(tmp_path / "r.json")) == outputs.write_json(part, str(tmp_path / "r.json"))
    labels = spark.createDataFrame([("i", 1, 0, 0.5, 0.5, 0.25, 0.25), ("i", 0, 2, 0.1, 0.1, 0.1, 0.1)], "image string, n int, class_id int, x double, y double, w double, h double")
    assert outputs.label_text(labels, ["image"], "n").first()["text"] == "2 0.10000000 0.10000000 0.10000000 0.10000000\n0 0.50000000 0.50000000 0.25000000 0.25000000"
    change = spark.createDataFrame([("m", 0.5, 0.75, 0.25), ("n", None, 0.1, None)], "metric string, before double, after double, change double")
    assert "| m | 0.5000 | 0.7500 | +0.2500 |" in outputs.comparison_markdown(change, "metric")


def test_detections(spark):
    df = spark.createDataFrame([("i", [(0, 0.3, [0.25, 1.26]), (1, 0.9, [1.0, 2.0])])], "id string, b array<struct<cls:int,conf:double,xyxy:array<double>>>")
    got = detections.extracted(df, ["id"], "b", {0: "x", 1: "y"}).collect()
    assert sorted((r["at"], r["class"], r["box"]) for r in got) == [(0, "x", [0.2, 1.3]), (1, "y", [1.0, 2.0])]
