import shutil

from pyspark.sql import functions as F

from engramix.streaming import episodes as E

SMALL = "/root/testdata/sf0.001"


def test_fatigue_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{SMALL}/events.parquet", tmp_path / "in")
    counts = E.fatigue_counts(E.access_stream(spark, str(tmp_path / "in")))
    run = counts.writeStream.outputMode("complete").format("memory").queryName("fatigue").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(str(r.window_start)[:10], r.session_id): r.n for r in spark.table("fatigue").collect()}
    batch = spark.read.parquet(f"{SMALL}/events.parquet").filter("event_type = 'view'").groupBy(F.to_date("ts").alias("d"), "user_id").count()
    assert got == {(str(r.d), r.user_id): r["count"] for r in batch.collect()}


def test_ingest_writes_each_episode_once(spark, tmp_path):
    rows = spark.createDataFrame([(i % 5, f"t{i % 5}") for i in range(20)], "episode_id long, content string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    E.ingest(stream, lambda df: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.episode_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_queue_worker_claims_by_priority(spark, tmp_path):
    rows = spark.createDataFrame([(i, 9 - i, "2024-01-01", "pending" if i % 2 else "done") for i in range(10)], "queue_id long, priority int, created_at string, status string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    E.work_queue(stream, lambda df: seen.extend(r.queue_id for r in df.collect()), 3, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [9, 7, 5]
