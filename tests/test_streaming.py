import datetime

import pytest

from folio.streaming import events

ATTEMPTS = [("u|1", t * 1000, i, ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, False), (3, False), (4, False), (5, True), (303, False), (304, False), (305, True), (306, False)])]
SCHEMA = "key string, time long, event_id long, success boolean"


def test_limiter(spark):
    rows = events.limited(spark.createDataFrame([*ATTEMPTS, ("v|1", 0, 99, False)], SCHEMA)).orderBy("key").collect()
    # locked from 4 s to 304 s: the success at 5 s and the failure at 303 s are rejected
    assert [tuple(r) for r in rows] == [("u|1", 1, 0, 1, 2), ("v|1", 1, 0, 0, 0)]


def test_limiter_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = str(tmp_path / "in")
    for n, part in enumerate((ATTEMPTS[:4], ATTEMPTS[4:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    try:
        query = events.limited_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    except ImportError as e:
        pytest.skip(f"stateful processors can't run here: {e}")
    except Exception as e:
        if "protobuf" in str(e) or "ModuleNotFoundError" in str(e):
            pytest.skip("stateful processors need a module that isn't installed")
        raise
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen[-1] == ("u|1", 1, 0, 1, 2)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_stateful(spark, tmp_path, schema, parts, query, trigger=None, until=None):
    """The rows that a stateful query gives for parts that arrive one after the other; one with a clock never ends by itself."""
    import time

    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    source, seen = str(tmp_path / "in"), []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    try:
        writer = query(stream).writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
        running = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(**(trigger or {"availableNow": True})).start()
        if until is None:
            running.awaitTermination(180)
        else:
            end = time.time() + 90
            while time.time() < end and not until(seen) and running.exception() is None:
                time.sleep(0.2)
            running.stop()
    except ImportError as e:
        pytest.skip(f"stateful processors can't run here: {e}")
    finally:
        spark.conf.unset(PROVIDER)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    return seen


def test_contents_expire(spark, tmp_path):
    schema = "book_url string, time long, event_id long, contents string"
    asked = [("a", t, i, None) for i, t in enumerate((299_999, 300_000, 300_001, 700_000, 700_001), 10)]
    parts = [[("a", 0, 1, "[1]"), ("b", 5, 2, None)], asked[:3], [("a", 400_001, 3, "[2]"), *asked[3:], ("b", 700_002, 20, None)]]
    seen = run_stateful(spark, tmp_path, schema, parts, events.contents_stream, until=lambda rows: len(rows) >= 7)
    assert {(b, i): (c, h) for b, i, c, h in seen} == {("b", 2): (None, False), ("a", 10): ("[1]", True), ("a", 11): ("[1]", True), ("a", 12): (None, False), ("a", 13): ("[2]", True), ("a", 14): ("[2]", True), ("b", 20): (None, False)}


TEXT = "data: a\r\n\r\nevent: end\ndata: 1\ndata: 2\n\n: note\n\ndata:x\rdata: y\r\revent: z\n\ndata: last\n\ndata: cut"


def batch_frames(spark, chunks):
    return sorted(map(tuple, events.frames(spark.createDataFrame(chunks, "stream string, seq int, chunk string")).select("stream", "place", "event", "data").collect()))


def test_frames_of_any_split():
    """Whatever the cuts, frame by frame is what the whole text gives."""
    import random

    whole, tail = events.cut_frames(TEXT)
    rng = random.Random(4)
    for _ in range(500):
        cuts = sorted(rng.sample(range(len(TEXT) + 1), rng.randint(0, 8)))
        found, held = [], ""
        for a, b in zip([0, *cuts], [*cuts, len(TEXT)]):
            more, held = events.cut_frames(held + TEXT[a:b])
            found += more
        assert (found, held) == (whole, tail)


def test_frames_stream(spark, tmp_path):
    """Chunks in any order and twice over give the batch form's frames."""
    import random

    rng = random.Random(6)
    chunks = []
    for name in ("s", "t"):
        cuts = sorted(rng.sample(range(1, len(TEXT)), 9))
        chunks += [(name, k, TEXT[a:b]) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(TEXT)]))]
    want = batch_frames(spark, chunks)
    assert [w[2:] for w in want if w[0] == "s"] == [x for x in events.cut_frames(TEXT)[0] if x]
    dealt = chunks + rng.sample(chunks, 6)
    rng.shuffle(dealt)
    seen = run_stateful(spark, tmp_path, "stream string, seq int, chunk string", [dealt[k::2] for k in range(2)], events.frames_stream, until=lambda rows: len(rows) >= len(want))
    assert sorted(seen) == want


def test_a_lost_chunk_is_given_up(spark, tmp_path):
    parts = [[("s", 0, "data: a\n\ndata: b"), ("s", 2, "c\n\ndata: d\n\n")]]
    query = lambda chunks: events.frames_stream(chunks, wait_ms=500)
    seen = run_stateful(spark, tmp_path, "stream string, seq int, chunk string", parts, query, {"processingTime": "300 milliseconds"}, lambda rows: len(rows) > 1)
    assert [(e, d) for _, _, e, d in seen] == [("message", "a"), ("message", "d")]


def test_daily_totals_stream(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, 23, 59)
    rows = [(day + datetime.timedelta(seconds=40 * k), "b") for k in range(4)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts timestamp, book_url string").write.parquet(source)
    stream = events.daily_reading(spark.readStream.schema("ts timestamp, book_url string").parquet(source))
    stream.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    batch = events.daily_reading(spark.read.parquet(source))
    expected = sorted(map(tuple, batch.collect()))
    assert sorted(map(tuple, spark.table("days").collect())) == expected == [("2024-01-01", "b", 60), ("2024-01-02", "b", 60)]


def test_frames(spark):
    chunks = [("s", 0, "data: a\r\n"), ("s", 1, "\r\nevent: end\ndata: 1\nda"), ("s", 2, "ta: 2\n\ndata: cut"), ("e", 0, ": note\n\n")]
    rows = events.frames(spark.createDataFrame(chunks, "stream string, seq int, chunk string")).orderBy("place").collect()
    assert [(r["event"], r["data"]) for r in rows] == [("message", "a"), ("end", "1\n2")]


def test_last_progress(spark):
    rows = spark.createDataFrame([("n", "b", 3, 0, 1), ("n", "b", 2, 9, 2)], "user_namespace string, book_url string, chapter_index long, chapter_pos long, seq long")
    assert [tuple(r) for r in events.last_progress(rows).collect()] == [("n", "b", 2, 9)]
