import datetime as dt
import zipfile

from pyspark.sql import functions as F

from lexivec.sources import archives, readers
from lexivec.streaming import correlate

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, ts timestamp, kind string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def ran(spark, writer, out, state, timed=False):
    w = writer.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True)
    (correlate.start_timed(spark, w) if timed else w.start()).awaitTermination()


def test_archives_of_odd_members(spark, tmp_path):
    with zipfile.ZipFile(f"{tmp_path}/b.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/one.txt", "eins\n")
        z.writestr("bad.txt", b"a\xffb")
        z.writestr("empty.txt", "")
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("long.txt", "x" * 3_000_000)
    zipfile.ZipFile(f"{tmp_path}/none.zip", "w").close()
    (tmp_path / ".hidden.zip").write_bytes(b"no archive")
    (tmp_path / "note.txt").write_text("no archive")
    archives.register(spark)
    for part in (200, 1 << 26):
        rows = spark.read.format("text_archive").option("partBytes", part).load(f"{tmp_path}").collect()
        assert sorted((r.archive, r.name, r.content[:10], len(r.content)) for r in rows) == [("a.zip", "long.txt", "x" * 10, 3_000_000), ("b.zip", "bad.txt", "a�b", 3), ("b.zip", "empty.txt", "", 0), ("b.zip", "folder/one.txt", "eins\n", 5)]
    docs = readers.load(spark, "archives", f"{tmp_path}")
    assert {r.source for r in docs.collect()} == {"a.zip/long.txt", "b.zip/bad.txt", "b.zip/empty.txt", "b.zip/folder/one.txt"}
    assert spark.read.format("text_archive").load(f"{tmp_path}/nowhere").count() == 0


def test_archives_as_a_sink(spark, tmp_path):
    archives.register(spark)
    rows = [("a", "x" * 10), ("a", "again"), (None, "unnamed"), ("", "no name"), ("null", None)]
    df = spark.createDataFrame([("", *r) for r in rows], archives.SCHEMA)
    out = f"{tmp_path}/out"
    df.coalesce(1).write.format("text_archive").mode("append").save(out)
    assert sorted(r.content for r in spark.read.format("text_archive").load(out).collect()) == sorted(c or "" for _, c in rows)
    df.repartition(3).write.format("text_archive").mode("append").option("archiveBytes", 1).save(out)
    assert spark.read.format("text_archive").load(out).count() == 10
    df.where("name = 'null'").write.format("text_archive").mode("overwrite").save(out)
    assert [r.name for r in spark.read.format("text_archive").load(out).collect()] == ["null"]
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    archives.register(spark)
    out = f"{tmp_path}/out"
    spark.createDataFrame([("", "a", "old")], archives.SCHEMA).write.format("text_archive").mode("append").save(out)
    bad = spark.range(4, numPartitions=4).select(F.lit("").alias("archive"), F.lit("n").alias("name"), F.expr("if(id = 3, raise_error('stop'), 'new')").alias("content"))
    try:
        bad.write.format("text_archive").mode("overwrite").save(out)
    except Exception as e:
        assert "stop" in str(e)
    else:
        raise AssertionError("it should have failed")
    assert [r.content for r in spark.read.format("text_archive").load(out).collect()] == ["old"]


def test_follow_ups_out_of_order(spark, tmp_path):
    views = [(1, at(0), "v"), (1, at(30), "v"), (2, at(5), "v"), (None, at(6), "v"), (3, None, "v"), (1, at(0), "v"), (9, at(9000), "end")]
    buys = [(1, at(60), "p"), (1, at(0), "p"), (2, at(66), "p"), (None, at(6), "p"), (9, at(9000), "end")]
    for name, rows in (("views", views), ("buys", buys)):
        for some in (rows[1:3], rows[:1] + rows[3:-1], rows[-1:]):  # the second batch is older than the first
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    a, b = (spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}") for name in ("views", "buys"))
    found = correlate.follow_ups(a, b, "user_id", "60 MINUTES", "2 hours")
    ran(spark, found, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted(((r.first_user_id or 0, r.first_ts, r.then_ts or T0 - dt.timedelta(1)) for r in spark.read.parquet(f"{tmp_path}/out").where("first_kind = 'v'").collect()))
    none = T0 - dt.timedelta(1)
    assert got == sorted([(1, at(0), at(0)), (1, at(0), at(60)), (1, at(0), at(0)), (1, at(0), at(60)), (1, at(30), at(60)), (2, at(5), none), (0, at(6), none)])


def test_sessions_by_timers(spark, tmp_path):
    rows = [(1, at(0), "v"), (1, at(9), "v"), (1, at(19), "v"), (1, at(20), "p"), (1, at(20), "v"), (1, at(21), "v"), (2, at(3), "p"), (2, at(3), "p"), (None, at(4), "v"), (4, None, "v"), (5, at(7), None)]
    for some in (rows[2:4], rows[:2] + rows[4:7], rows[7:], [(9, at(9000), "end")]):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("key", F.lit("other"))
    found = correlate.timed_sessions(live, "user_id", F.col("kind") == "p", 600, "1 hour")
    ran(spark, found, f"{tmp_path}/out", f"{tmp_path}/state", timed=True)
    got = {(r.user_id, r.session_start, r.session_end, r.n, r.closed) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # a pause as long as the gap parts sessions; of rows of one time the closing one is last
    assert got == {(1, at(0), at(9), 2, False), (1, at(19), at(20), 3, True), (1, at(21), at(21), 1, False), (2, at(3), at(3), 1, True), (None, at(4), at(4), 1, False), (5, at(7), at(7), 1, False)} and spark.read.parquet(f"{tmp_path}/out").count() == 7
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != correlate._ROCKS


def test_sessions_of_many_keys_share_calls_of_state(spark, tmp_path):
    far = [(9, at(90000), "end")]
    rows = [(2**53 + i, at(m), "p" if i % 3 == 0 and m == 3 else "v") for i in range(900) for m in (1, 2, 3, 30)]
    for some in (rows[::2], rows[1::2], far):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = correlate.start_timed(spark, correlate.timed_sessions(live, "user_id", F.col("kind") == "p", 600, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True))
    query.awaitTermination()
    got = sorted((r.user_id, r.session_start, r.session_end, r.n, r.closed) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(x for i in range(900) for x in ((2**53 + i, at(1), at(3), 3, i % 3 == 0), (2**53 + i, at(30), at(30), 1, False)))
    # a state for each bucket, not for each key
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * correlate.BUCKETS
