"""Keyed ingest and event-time roll-ups: several batches equal one, replays change nothing, late rows are counted."""
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kgweave.streaming import events as E, ingest as I

DOCS = [(str(i), t) for i, t in enumerate([
    "Ann met Bob. Bob left the town.", "Ann met Bob. Bob left the town.", "Ann saw Cy. Cy met Bob.", "Dan met Ann. Bob left the town.", "nothing", "Ann met Eve. Eve saw Ann."])]


def run(spark, base, name, batches, again=False):
    src, out, ck = base / name / "in", base / name / "out", base / name / "ck"
    src.mkdir(parents=True, exist_ok=True)
    query = None
    for i, docs in enumerate(batches):
        (src / f"{i}.jsonl").write_text("\n".join(json.dumps({"id": k, "text": t, "metadata": {}}) for k, t in docs))
        query = I.ingest(I.document_stream(spark, str(src)), str(out), str(ck))
        query.awaitTermination()
    if again:
        query = I.ingest(I.document_stream(spark, str(src)), str(out), str(ck))
        query.awaitTermination()
    tables = {t: rows(spark.read.parquet(str(out / t)).drop("batch")) for t in ("nodes", "edges", "text_nodes")}
    ends = spark.read.parquet(str(out / "text_edges"))
    assert ends.count() == ends.select("start_id").distinct().count() == len(tables["nodes"])
    return tables, I.state_rows(query)


def test_three_batches_equal_one(spark, tmp_path):
    one, n_one = run(spark, tmp_path, "one", [DOCS])
    three, n_three = run(spark, tmp_path, "three", [DOCS[:2], DOCS[2:4], DOCS[4:]])
    assert [r for r in one["edges"]] == three["edges"] and one["text_nodes"] == three["text_nodes"]
    # a name's kind is that of its first mention; here no name is both entity and event
    assert one["nodes"] == three["nodes"]
    assert n_one == n_three == len(one["nodes"]) + len(one["text_nodes"])


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first, n = run(spark, tmp_path, "r", [DOCS[:3], DOCS[3:]])
    # the same documents arrive again as new files
    again, m = run(spark, tmp_path, "r2", [DOCS[:3], DOCS[3:], DOCS], again=True)
    assert first["nodes"] == again["nodes"] and first["text_nodes"] == again["text_nodes"]
    assert n == len(first["nodes"]) + len(first["text_nodes"])


def test_first_mentions_without_python_state(spark, tmp_path, monkeypatch):
    """Keys are kept by a streaming aggregate, not by a Python call per key; the earliest place of a batch wins, then arrival."""
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithStateInPandas", None)
    src = str(tmp_path / "c")

    def add(*c):
        spark.createDataFrame([(*x, None) for x in c], I.CANDIDATE).coalesce(1).write.mode("append").parquet(src)
    out = {}

    def keep(df, batch):
        out.setdefault(batch, []).extend(rows(df, "kind", "key", "type", "text_id"))

    def go():
        q = I.first_seen(spark.readStream.schema(I.CANDIDATE).parquet(src)).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    add(("node", "a", "2", "event", "y"), ("node", "a", "1", "entity", "x"), ("node", "b", "3", "entity", "x"), ("text", "a", "1", None, None))
    go()
    add(("node", "a", "0", "event", "z"), ("node", "c", "5", "entity", "z"), ("node", "c", "4", "event", "w"))
    q = go()
    assert out[0] == [("node", "a", "entity", "x"), ("node", "b", "entity", "x"), ("text", "a", None, None)]
    assert out[1] == [("node", "c", "event", "w")]
    assert I.state_rows(q) == 4


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def add(spark, folder, name, events):
    df = spark.createDataFrame([(i, t, u, k, v) for i, (t, u, k, v) in enumerate(events)], "event_id long, t string, user_id long, event_type string, value double")
    df.select("event_id", F.col("t").cast("timestamp").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{folder}")


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture()
def feed(spark, tmp_path):
    """Three files: the second brings a row within the lateness and, later, one far too late."""
    src = str(tmp_path / "events")
    add(spark, src, "a", [("2024-01-01 00:10:00", 1, "x", 1.0), ("2024-01-01 00:20:00", 2, "x", 2.0), ("2024-01-01 01:10:00", 1, "y", 3.0)])
    windows, state = str(tmp_path / "w"), str(tmp_path / "wc")
    sessions, closed = str(tmp_path / "s"), str(tmp_path / "sc")

    def go():
        out = [E.write_windows(stream(spark, src), windows, state), E.write_sessions(stream(spark, src), sessions, closed)]
        for q in out:
            q.awaitTermination()
        return out
    return src, windows, sessions, go


def test_windows_and_sessions_with_late_rows(spark, feed):
    src, windows, sessions, go = feed
    go()
    add(spark, src, "b", [("2024-01-01 00:30:00", 1, "x", 10.0), ("2024-01-01 09:00:00", 1, "x", 4.0)])  # 40 minutes behind: counted
    go()
    add(spark, src, "c", [("2024-01-01 00:40:00", 1, "x", 100.0), ("2024-01-01 09:30:00", 1, "x", 5.0)])  # behind the watermark of 07:00: dropped
    late = go()
    got = rows(E.read_windows(spark.read.parquet(windows)).select(F.date_format("hour", "HH").alias("h"), "event_type", "n_events", "n_users", "total"))
    assert got == [("00", "x", 3, 2, 13.0), ("01", "y", 1, 1, 3.0), ("09", "x", 2, 1, 9.0)]
    assert E.dropped_rows(late[0]) == 1 and E.dropped_rows(late[1]) == 1
    for day in ("2030-01-01", "2030-01-02"):  # the watermark of a batch takes effect in the next one
        add(spark, src, "d", [(f"{day} 00:00:00", None, "end", 0.0)])
        go()
    done = spark.read.parquet(sessions).select("user_id", F.date_format("started", "HH:mm"), F.date_format("last_event", "HH:mm"), "n_events")
    assert rows(done) == [(1, "00:10", "01:10", 3), (1, "09:00", "09:30", 2), (2, "00:20", "00:20", 1)]
