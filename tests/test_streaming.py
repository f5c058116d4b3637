from pyspark.sql import functions as F

from siftwork.streaming import incremental


def drain(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_df.sparkSession.table(name).collect()


def source(spark, tmp_path):
    rows = [(i, f"s{i % 3}", f"d{i % 4}", 1, 1, f"2024-01-01 00:{i:02}:00") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, sha256 string, dhash string, width int, height int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_stream(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    held = df.filter("sha256 = 's0'")
    kept = drain(incremental.protected_stream(stream, held), "kept")
    assert {r["id"] for r in kept} == {i for i in range(12) if i % 3}
    first = drain(incremental.first_seen(stream, "t", "2 hours"), "first")
    assert len(first) == 4
    counts = drain(incremental.windowed_counts(stream, "t", ["dhash"], "6 minutes", "0 seconds"), "counts", "complete")
    assert sum(r["n"] for r in counts) == 12


def test_best_row_replaces_the_kept_one(spark, tmp_path):
    """Files come one at a time, in an order that isn't the priorities'; the changes add up to the batch result."""
    import random

    from siftwork.operators import dedup

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(3)
    rows = [(i, r.randrange(5) if i % 9 else None, f"d{r.randrange(12)}", 1, 1, f"2024-01-01 00:{i % 60:02}:00") for i in range(90)]
    schema = "id long, priority int, dhash string, width int, height int, t string"
    df = spark.createDataFrame(rows, schema).withColumn("t", F.to_timestamp("t"))
    for k in range(3):
        df.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = drain(incremental.best_seen(stream, "t", "2 hours", 86400, ["priority", "id"]), "best")
    held = {}
    for c in changes:
        held[c["id"]] = held.get(c["id"], 0) + (1 if c["change"] == "keep" else -1)
    want = {x["id"] for x in dedup.deduplicate(df, ["priority", "id"]).collect()}
    assert {i for i, n in held.items() if n} == want and set(held.values()) <= {0, 1}
    assert any(c["change"] == "retract" for c in changes)
    assert {c["id"]: c["t"] for c in changes} == {x["id"]: x["t"] for x in df.filter(F.col("id").isin([c["id"] for c in changes])).collect()}
