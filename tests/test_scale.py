"""What keeps work in bounds as tables and trees grow."""

import hashlib
import zipfile

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from siftwork.functions import resample
from siftwork.plans import builds
from siftwork.sinks import outputs
from siftwork.sources import config, files, scan, storage


def test_many_folders_are_listed_by_few_tasks(tmp_path):
    for k in range(40):
        (tmp_path / f"runs/u{k}/deep").mkdir(parents=True)
        (tmp_path / f"runs/u{k}/a.txt").write_bytes(b"x" * k)
        (tmp_path / f"runs/u{k}/deep/b").write_bytes(b"")
    (tmp_path / "runs/top").write_bytes(b"1")
    (tmp_path / "runs/gone").symlink_to(tmp_path / "nowhere")
    reader = storage.FolderReader({"path": f"file:{tmp_path}", "folders": "4"})
    parts = reader.partitions()
    assert len(parts) <= storage.SHARES + 4
    seen = [(r["path"], r["length"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    want = [(f"file:{tmp_path}/runs/u{k}/{n}", k if n == "a.txt" else 0) for k in range(40) for n in ("a.txt", "deep/b")] + [(f"file:{tmp_path}/runs/top", 1)]
    assert sorted(seen) == sorted(want)


def test_wide_folder_is_listed_by_shares(tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PEEK", 20)
    for k in range(50):
        (tmp_path / f"{k}.jpg").write_bytes(b"")
    for deep in ("true", "false"):
        reader = storage.FolderReader({"path": f"file:{tmp_path}", "recursive": deep})
        shares = [[r["path"] for b in reader.read(p) for r in b.to_pylist()] for p in reader.partitions()]
        assert len(shares) == storage.SHARES and max(map(len, shares)) < 50
        assert sorted(p for s in shares for p in s) == sorted(f"file:{tmp_path}/{k}.jpg" for k in range(50))


def test_digests_of_files_beyond_a_part(spark, tmp_path):
    data = bytes(range(256)) * (files.PART_BYTES // 100)
    (tmp_path / "big").write_bytes(data)
    (tmp_path / "none").write_bytes(b"")
    rows = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("big", "none", "gone")], "path string")
    got = {r["path"].rpartition("/")[2]: r["sha256"] for r in files.digests(rows).collect()}
    assert got == {"big": hashlib.sha256(data).hexdigest(), "none": hashlib.sha256(b"").hexdigest(), "gone": None}


def test_members_share_batches(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(2500):
            z.writestr(f"{k}", str(k))
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        rows = [{"archive": f"file:{tmp_path}/a.zip", "member": i.filename, "header": i.header_offset, "packed": i.compress_size, "size": i.file_size, "method": i.compress_type, "flags": i.flag_bits, "crc": i.CRC} for i in z.infolist()]
    out = list(files.inflated(iter([pa.RecordBatch.from_pylist(rows)])))
    assert [b.num_rows for b in out] == [1000, 1000, 500]
    assert all(r["content"] == r["member"].encode() for b in out for r in b.to_pylist())


def test_kept_weights_are_bounded():
    for size in range(20_000, 20_100):
        made = resample._matrix("area", size, 8)
    assert sum(m.nbytes for m in resample._kept.values()) == resample._held[0] <= resample.KEPT_BYTES
    for size in (1, 3, 8, 9, 20, 20_099):
        made = resample._matrix("area", size, 8)
        assert {(int(c), int(x), int(made[x, c])) for x, c in zip(*made.nonzero())} == set(resample.area_weights(size, 8))


@pytest.mark.parametrize("mode", builds.MODES)
def test_a_build_reads_its_records_once(spark, tmp_path, mode):
    rows = spark.range(60).select(
        "id", F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), (F.col("id") % 7).cast("string").alias("family_id"), F.col("id").cast("string").alias("image_path"),
        (F.col("id") % 5 == 0).alias("is_negative"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"), (F.col("id") % 50).cast("string").alias("dhash"), F.lit(1).alias("width"), F.lit(1).alias("height"),
    )
    rows.write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    done = builds.build(read.filter("source <> 's0'"), read.filter("source = 's0'"), ["s1", "s2"], 0.2, 0.3, 1, mode)
    for df in (done.kept, done.dropped):
        assert df.inputFiles() and not [f for f in df.inputFiles() if str(tmp_path) in f]
    assert done.kept.count() + done.dropped.count() == 40


def test_a_dataset_is_written_in_one_pass(spark, tmp_path):
    picture = bytes(range(256)) * (files.PART_BYTES // 100)
    (tmp_path / "a.jpg").write_bytes(picture)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(20).select(F.lit("train").alias("final_split"), F.lit(f"file:{tmp_path}/a.jpg").alias("image_path"), F.concat(F.lit("s"), "id", F.lit(".jpg")).alias("output_name"), F.array(F.concat("id", F.lit(" 1 1 1 1"))).alias("labels"))
    records, out = rows.mapInArrow(counted, rows.schema), tmp_path / "out"
    outputs.write_dataset(records, str(out))
    assert seen.value == 20
    want = {f"train/images/s{k}.jpg": picture for k in range(20)} | {f"train/labels/s{k}.txt": b"%d 1 1 1 1\n" % k for k in range(20)}
    assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file()} == want
    lost = rows.limit(1).withColumn("image_path", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="cannot read an image without path"):
        outputs.write_dataset(lost, str(out))
    assert len(list(out.rglob("*.jpg"))) == 20


def test_attempts_leave_whole_files(tmp_path):
    local = fs.LocalFileSystem()
    for system, base in ((local, f"{tmp_path}/"), (fs.SubTreeFileSystem(str(tmp_path), local), "")):
        path = tmp_path / "a.txt"
        # another attempt has begun the file and goes on when this one is done
        with open(path, "wb", buffering=0) as other:
            other.write(b"par")
            outputs.TreeWriter._file(system, f"{base}a.txt", iter([b"par", b"t"]))
            other.write(b"t and more")
        assert path.read_bytes() == b"part"
        outputs.TreeWriter._file(system, f"{base}a.txt", iter([b"part"]))
        outputs.TreeWriter._file(system, f"{base}b.txt", iter([]))
        assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.txt": b"part", "b.txt": b""}


def test_paired_records_list_and_read_once(spark, tmp_path):
    for name, text in {"images/a.jpg": "i", "labels/a.txt": "0 1 1 1 1", "labels/a.TXT": "0 0 0 1 1"}.items():
        (tmp_path / "train" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "train" / name).write_text(text)
    done = scan.paired_records(spark, config.SourcePolicy("s", str(tmp_path), {0: 2}))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and storage.FolderSource.name() not in plan
    # what comes after the check that all files pair isn't in the records
    (tmp_path / "train/labels/b.txt").write_text("0 1 1 1 1")
    got = [(r["image_path"].rpartition("/")[2], r["label_path"].rpartition("/")[2], len(r["labels"])) for r in done.collect()]
    assert got == [("a.jpg", "a.TXT", 2)]
