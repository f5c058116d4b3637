"""Operators against small sequential models of what they mean."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions.keys import seeded_order
from siftwork.operators import checks, classify, dedup, match, records, report, select
from siftwork.operators.ordering import placed
from siftwork.plans import builds


def test_classification(spark):
    rows = [("a", "target"), ("a", "target"), ("b", "negative"), ("c", "target"), ("c", None), ("d", "negative"), ("d", "target"), ("e", "unsupported")]
    df = spark.createDataFrame(rows, "image string, role string")
    got = {r["image"]: r["decision"] for r in classify.classify(df, ["image"]).collect()}
    assert got == {"a": "target", "b": "negative_candidate", "c": "ambiguous", "d": "ambiguous", "e": "ambiguous"}


def test_drop_reasons_take_precedence(spark):
    rows = [("a", None, None, None), ("b", "l", 6, "unsupported"), ("c", "l", 5, "unsupported"), ("d", "l", 5, None), ("e", "l", 5, "target")]
    df = spark.createDataFrame(rows, "image string, line string, n int, role string")
    got = {r[0]: r[1] for r in classify.drop_reasons(df, ["image"], "line", "n").collect()}
    assert got == {"a": "empty_label", "b": "non_detection_label", "c": "unsupported_class", "d": "unknown_class", "e": None}
    kept = {r[0]: r[1] for r in classify.drop_reasons(df, ["image"], "line", "n", preserve_empty=True).collect()}
    assert kept["a"] is None


def pictures(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d = rng.randrange(12)
        rows.append((f"i{i:03}", f"s{rng.randrange(3)}", f"{d}-{rng.randrange(3)}", str(d), 1, 1, rng.random() < 0.4))
    return rows, spark.createDataFrame(rows, "id string, source string, sha256 string, dhash string, width int, height int, is_negative boolean")


@pytest.mark.parametrize("seed", range(3))
def test_duplicates_and_their_counts(spark, seed):
    rows, df = pictures(spark, 60, seed)
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    seen_sha, seen_key, kept, exact, like = {}, {}, [], 0, 0
    first = {}
    for r in rows:
        if r[2] in seen_sha:
            exact += 1
            continue
        seen_sha[r[2]] = r
    for r in seen_sha.values():
        if r[3] in seen_key:
            like += 1
            continue
        seen_key[r[3]] = r
        kept.append(r[0])
    for r in rows:
        first.setdefault(r[3], r)
    one = [sum(r[2] == first[r[3]][2] and r is not first[r[3]] for r in rows), sum(r[2] != first[r[3]][2] for r in rows)]
    order = ["source", "id"]
    assert sorted(r["id"] for r in dedup.deduplicate(df, order).collect()) == sorted(kept)
    assert tuple(dedup.two_passes(df, "sha256", match.PERCEPTUAL).first())[:2] == (exact, like)
    assert list(dedup.one_pass(df, "sha256", match.PERCEPTUAL, order).first())[:2] == one


def test_priority_must_name_every_source(spark):
    df = spark.createDataFrame([("a",), ("b",)], "source string")
    with pytest.raises(Exception, match="without priority"):
        df.select(dedup.priority_of(F.col("source"), ["a"])).collect()


def test_exact_match_wins(spark):
    cols = "id string, sha256 string, dhash string, width int, height int"
    records = spark.createDataFrame([("a", "x", "d", 1, 1), ("b", "y", "d", 1, 1), ("c", "z", "d", 2, 1), ("n", None, None, None, None)], cols)
    held = spark.createDataFrame([("h", "x", "d", 1, 1), ("g", None, None, None, None)], cols)
    got = {r["id"]: r["match"] for r in match.match_kind(records, held).collect()}
    assert got == {"a": "exact", "b": "perceptual", "c": None, "n": None}
    assert {r["id"] for r in match.protect(records, held).collect()} == {"c", "n"}


def test_pairing(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "stem string"), spark.createDataFrame([("y",), ("z",)], "stem string")
    assert {r[0]: r[1] for r in match.pair(a, b, ["stem"]).collect()} == {"x": "image_only", "y": "paired", "z": "label_only"}


def test_positions_equal_a_global_sort(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("size"), (F.col("id") % 2).alias("g")).withColumn("o", seeded_order(1, F.col("id")))
    got = {r["id"]: (r["position"], r["before"]) for r in placed(df, "o", by=["g"], size="size", tie=["id"]).collect()}
    for g in (0, 1):
        total = 0
        for k, r in enumerate(sorted((r for r in df.collect() if r["g"] == g), key=lambda r: (r["o"], r["id"])), 1):
            assert got[r["id"]] == (k, total)
            total += r["size"]


def test_cap(spark):
    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(16)], "id int, neg boolean")
    kept = select.cap_negatives(df, "neg", "id", 0.20, 26).collect()
    assert (len(kept), sum(r["neg"] for r in kept)) == (10, 2)
    same = lambda s: {r["id"] for r in select.cap_negatives(df, "neg", "id", 0.4, s).collect()}
    assert same(26) == same(26) and any(same(26) != same(s) for s in range(5))
    # doubles: 0.2 * 172 / 0.8 is just below 43
    many = spark.range(372).select(F.col("id"), (F.col("id") >= 172).alias("neg"))
    assert select.cap_negatives(many, "neg", "id", 0.2, 1).filter("neg").count() == 42
    assert select.cap_negatives(df.filter("neg"), "neg", "id", 0.2, 1).count() == 0
    with pytest.raises(ValueError):
        select.cap_negatives(df, "neg", "id", 1.0, 1)


def by_records(fams, fraction):
    """Sequential model of split_by_records; fams in seeded order as (family, source, size)."""
    if len(fams) <= 1:
        return set()
    target, sources = max(1, round(sum(f[2] for f in fams) * fraction)), {f[1] for f in fams}
    valid, count = [], 0
    if target >= len(sources) and len(fams) > len(sources):
        seen = set()
        for f in fams:
            if f[1] not in seen:
                seen.add(f[1])
                valid.append(f[0])
                count += f[2]
    for f in fams:
        if f[0] in valid:
            continue
        if count >= target or len(valid) >= len(fams) - 1:
            break
        valid.append(f[0])
        count += f[2]
    return set(valid)


def by_families(fams, fraction):
    if len(fams) < 2:
        return set()
    target = min(max(1, round(len(fams) * fraction)), len(fams) - 1)
    n = {}
    for f in fams:
        n[f[1]] = n.get(f[1], 0) + 1
    eligible, valid = [s for s in n if n[s] >= 2], set()
    if target >= len(eligible):
        for s in eligible:
            valid.add(next(f[0] for f in fams if f[1] == s))
    used = {s: sum(f[0] in valid for f in fams if f[1] == s) for s in n}
    for spare in (False, True):
        for f in fams:
            if len(valid) >= target:
                break
            if f[0] not in valid and (spare or used[f[1]] + 1 <= n[f[1]] - 1):
                valid.add(f[0])
                used[f[1]] += 1
    return valid


@pytest.mark.parametrize("seed", range(4))
def test_splits(spark, seed):
    rng = random.Random(seed)
    rows = [(f"f{i}", f"s{rng.randrange(3)}") for i in range(rng.randrange(2, 25)) for _ in range(rng.randrange(1, 5))]
    source = {}
    rows = [(f, source.setdefault(f, s)) for f, s in rows]
    df = spark.createDataFrame(rows, "family string, source string")
    fams = select.families_of(df, "family", "source").withColumn("o", seeded_order(seed, F.col("family"))).orderBy("o", "family").collect()
    fams = [(r["family"], r["source"], r["size"]) for r in fams]
    for fraction in (0.1, 0.4, 0.8):
        for split, model in ((select.split_by_records, by_records), (select.split_by_families, by_families)):
            got = {r["family"] for r in split(df, "family", "source", fraction, seed).collect() if r["split"] == "valid"}
            assert got == model(fams, fraction), (split.__name__, fraction)


def test_one_family_is_train(spark):
    df = spark.createDataFrame([("f", "s")] * 3, "family string, source string")
    for split in (select.split_by_records, select.split_by_families):
        assert [r["split"] for r in split(df, "family", "source", 0.5, 1).collect()] == ["train"]


def test_primary_class(spark):
    freq = F.create_map(*[F.lit(v) for v in (0, 100, 1, 40, 2, 80, 3, 120)])
    df = spark.createDataFrame([([0, 1, 3],)], "c array<int>")
    assert df.select(select.primary_class(F.col("c"), freq)).first()[0] == 1


def test_balanced_quotas(spark):
    rows = [(i, [i % 4], "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, classes array<int>, source string")
    got = select.balanced(df, "id", "classes", F.col("source") == "a", 42, 7, 0.7, [0, 1, 2, 3]).collect()
    per = {c: sum(r["primary"] == c for r in got) for c in range(4)}
    assert len(got) == 42 and sorted(per.values()) == [10, 10, 11, 11]
    assert sum(r["source"] == "a" and r["primary"] == 0 for r in got) == round(11 * 0.7)


def test_violations(spark):
    lines = ["1 0.25 0.75 1 0.5", "1 0.25 0.75 1", "9 0.25 0.75 1 0.5", "1 1.25 0.75 1 0.5", "1 0.25 -0.75 1 0.5", "1 0.25 0.75 0 0.5", "1 0.25 0.75 1 1.5", "one 0.25 0.75 1 0.5"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["code"]: r["n"] for r in checks.label_violations(df, "line", [0, 1, 2, 3]).collect()}
    codes = ["non_five_token_label", "invalid_class_id", "invalid_x_center", "invalid_y_center", "invalid_width", "invalid_height", "invalid_label_value"]
    assert got == dict.fromkeys(codes, 1)
    assert checks.failure_codes(checks.label_violations(df, "line", [1])) == sorted(codes)
    with pytest.raises(ValueError):
        checks.require_rows(df, 3)


def test_class_lists_must_be_equal_in_order(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "i int, name string")
    assert checks.require_classes(df, "i", "name", ["a", "b"]) is df
    for other in (["b", "a"], ["a"], ["a", "b", "c"]):
        with pytest.raises(ValueError):
            checks.require_classes(df, "i", "name", other)


def test_conversion_raises_or_counts(spark):
    classes = spark.createDataFrame([(1, 0, "target"), (2, 0, "target")], "source_class int, target_class int, role string")
    rows = [("a", 0, "1 .5 .5 .5 .5"), ("a", 1, "2 .5 .5 .5 .5"), ("a", 2, "2 .5 .5 .5 .50"), ("b", None, None)]
    df = spark.createDataFrame(rows, "image string, line_no int, line string")
    got = {(r["image"], r["line_no"]): (r["text"], r["repeats"]) for r in records.converted(df, ["image"], classes).collect()}
    assert got == {("a", 0): ("0 .5 .5 .5 .5", 1), ("a", 2): ("0 .5 .5 .5 .50", 0)}
    for bad in ("3 .5 .5 .5 .5", "1 .5 .5"):
        with pytest.raises(Exception, match="invalid label line"):
            records.converted(spark.createDataFrame([("a", 0, bad)], df.schema), ["image"], classes).collect()
    unknown = spark.createDataFrame([("a", 0, "7 .5 .5 .5 .5")], df.schema)
    assert records.remapped(unknown, ["image"], classes).first()["drop_reason"] == "unknown_class"
    with pytest.raises(Exception, match="unknown_class"):
        records.remapped(unknown, ["image"], classes, on_unknown="error").collect()


def test_best_and_last(spark):
    rows = [("r", 1, 0.5), ("r", 2, 0.9), ("r", 3, 0.9), ("r", 4, float("nan")), ("q", 1, None)]
    df = spark.createDataFrame(rows, "run string, epoch int, m double")
    got = {r["run"]: r for r in report.best_and_last(df, ["run"], "m", ["epoch"]).collect()}
    assert (got["r"]["rows"], got["r"]["best"]["epoch"]) == (4, 2)
    assert got["q"]["best"] is None


@pytest.mark.parametrize("mode", builds.MODES)
def test_build_is_leak_free(spark, mode):
    rows, df = pictures(spark, 120, 5)
    records = df.filter("source <> 's0'").withColumn("family_id", F.concat("source", F.lit(":"), "dhash")).withColumn("image_path", F.concat("id", F.lit(".jpg")))
    done = builds.build(records, df.filter("source = 's0'").limit(6), ["s2", "s1"], 0.3, 0.4, 26, mode)
    kept, dropped = done.kept.collect(), done.dropped.collect()
    assert len(kept) + len(dropped) == records.count()
    assert all(r["drop_reason"] for r in dropped)
    sides = {}
    for r in kept:
        sides.setdefault(r["family_id"], set()).add(r["final_split"])
    assert all(len(s) == 1 for s in sides.values())
    assert len({r["dhash"] for r in kept}) == len(kept)
    assert not checks.split_violations(done.kept, "final_split", {"family_overlap": ["family_id"], "exact": ["sha256"]}).collect()


def test_leakage_safe_build(spark):
    cols = "key string, path string"
    train = spark.createDataFrame([("a", "t1"), ("b", "t2")], cols)
    valid = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("c", "v3")], cols)
    done = builds.leakage_safe(train, valid, "key", "path")
    assert {(r["path"], r["final_split"]) for r in done.kept.collect()} == {("t2", "train"), ("v1", "valid"), ("v3", "valid")}
    assert {(r["path"], r["drop_reason"]) for r in done.dropped.collect()} == {("t1", "in_valid"), ("v2", "same_key")}
