"""Streams that run to the end of their input: several batches, a restart from the checkpoint, late rows."""

import datetime as dt

from pyspark.sql import functions as F

from tracemill.streaming import lines

SCHEMA = "line_id long, user_id long, event_id string, label int, ts timestamp"
START = dt.datetime(2024, 1, 1)


def put(spark, path, rows):
    """Append one file of (line, user, event, label, seconds)."""
    values = [(n, u, e, y, START + dt.timedelta(seconds=s)) for n, u, e, y, s in rows]
    spark.createDataFrame(values, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sessions(spark, path, tmp_path, files=1):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path)
    stream = lines.gap_sessions(events, "ts", "user_id", 60, 30, event="event_id", order="line_id")
    return lines.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))


def shown(ended):
    seconds = lambda c: (F.unix_seconds(c) - int(START.replace(tzinfo=dt.timezone.utc).timestamp())).cast("int").alias(c)
    rows = ended.rows.where("user_id < 9").select("user_id", seconds("first"), seconds("last"), "length", "label", F.array_join("events", "").alias("events"))
    return sorted(map(tuple, rows.collect()))


def test_sessions_over_a_restart_with_late_rows(spark, tmp_path):
    path = str(tmp_path / "in")
    put(spark, path, [(1, 1, "a", 0, 0), (2, 1, "b", 0, 60), (3, 2, "c", 1, 10)])
    put(spark, path, [(4, 1, "d", 1, 59), (5, 1, "e", 0, 100), (6, 9, "x", 0, 400)])
    first = sessions(spark, path, tmp_path)
    # User 1's session lasts from 0 to 100: the gap of exactly 60 seconds joins, and the watermark (370) has passed it.
    assert shown(first) == [(1, 0, 100, 4, 1, "adbe"), (2, 10, 10, 1, 1, "c")]
    assert (first.read, first.late) == (6, 0) and first.batches >= 2
    put(spark, path, [(7, 1, "f", 0, 380), (8, 2, "g", 0, 5), (9, 2, "h", 0, 390)])
    put(spark, path, [(10, 1, "i", 0, 430), (11, 9, "y", 0, 2000)])
    again = sessions(spark, path, tmp_path)
    # The row at second 5 is behind the watermark; nothing of the first run is read or written twice.
    assert shown(again) == [(1, 0, 100, 4, 1, "adbe"), (1, 380, 430, 2, 0, "fi"), (2, 10, 10, 1, 1, "c"), (2, 390, 390, 1, 0, "h")]
    assert (again.read, again.late) == (5, 1)
    assert shown(sessions(spark, path, tmp_path)) == shown(again)


def test_a_stream_equals_the_batch_over_the_same_lines(spark, tmp_path):
    rows = [(k, k % 4, "abc"[k % 3], int(k % 17 == 0), (k * 37) % 50 + k * 11) for k in range(200)]
    path = str(tmp_path / "in")
    for at in range(0, 200, 50):
        put(spark, path, rows[at : at + 50])
    put(spark, path, [(999, 9, "end", 0, 10**6)])
    got = shown(sessions(spark, path, tmp_path, files=2))
    expected = []
    for user in range(4):
        own = sorted((s, n, e, y) for n, u, e, y, s in rows if u == user)
        runs = [[own[0]]]
        for r in own[1:]:
            if r[0] - runs[-1][-1][0] > 60:
                runs.append([])
            runs[-1].append(r)
        expected += [(user, r[0][0], r[-1][0], len(r), max(x[3] for x in r), "".join(x[2] for x in r)) for r in runs]
    assert got == sorted(expected)
