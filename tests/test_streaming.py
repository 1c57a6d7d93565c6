"""Debouncing out of order and late, and delivery with failures, crashes and replays."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from rankweave.streaming import debounce, deliver

# Workers cannot import this module, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
START = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp, v long"


def streamed(spark, tmp_path, files: list[list[tuple]], made):
    """Rows (k, minutes, v) in files that arrive one after the other, each a batch; what the stream puts out."""
    for rows in files:
        spark.createDataFrame([(k, START + timedelta(minutes=m), v) for k, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found = made(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect(), query


FILES = [[("a", 0, 1), ("a", 8, 2), ("b", 5, 3)], [("a", 4, 4), ("a", 30, 5), ("b", 16, 6)], [("b", 60, 7), ("a", 24, 8)], [("a", -40, 9), ("c", 500, 0)]]


def test_bursts(spark, tmp_path):
    rows, query = streamed(spark, tmp_path, FILES, lambda s: debounce.quiet_bursts(s, "k", "at", "10 minutes", "20 minutes"))
    minute = lambda t: (t - START).total_seconds() / 60
    got = sorted((r["k"], minute(r["first"]), minute(r["last"]), r["n"], r["change"]["v"]) for r in rows)
    # The change of 40 minutes before the start comes when the clock stands at 60, too late.
    assert got == [("a", 0, 8, 3, 2), ("a", 24, 30, 2, 5), ("b", 5, 5, 1, 3), ("b", 16, 16, 1, 6), ("b", 60, 60, 1, 7)]
    assert debounce.dropped_late(query) == 1


def test_leading_edges(spark, tmp_path):
    rows, query = streamed(spark, tmp_path, FILES, lambda s: debounce.leading_edges(s, "k", "at", timedelta(minutes=10), "20 minutes"))
    got = sorted((r["k"], (r["at"] - START).total_seconds() / 60) for r in rows)
    assert got == [("a", 0), ("a", 24), ("b", 5), ("b", 16), ("b", 60)]
    assert debounce.dropped_late(query) == 1


ROW = "id long, v string"


def sink_to(folder, fails):
    """A sink that notes what it gets in files, and fails as told by fails(id, attempt)."""
    folder = str(folder)

    def send(row: dict, attempt: int) -> None:
        import uuid
        from pathlib import Path

        Path(folder, f"{row['id']}-{attempt}-{row['v']}-{uuid.uuid4().hex[:6]}").touch()
        if fails(row["id"], attempt):
            raise ValueError(f"no {row['id']}")

    return send


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "calls").mkdir()
    return tmp_path / "calls"


@pytest.fixture
def sink(folder):
    return sink_to(folder, lambda i, attempt: i == 7 or i == 3 and attempt < 3)


def calls(folder) -> list[tuple]:
    return sorted((int(a), int(b), c) for a, b, c, _ in (p.name.split("-") for p in folder.iterdir()))


def test_retries_and_quarantine(spark, tmp_path, folder, sink):
    state, now, slept = f"{tmp_path}/state", [100.0], []
    rows = spark.createDataFrame([(i, "x") for i in range(9)], ROW)
    assert deliver.step(spark, rows, 0, ROW, "id", state, sink, now[0])

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    deliver.drain(spark, ROW, "id", state, sink, clock=lambda: now[0], sleep=sleep)
    assert slept == [5.0, 10.0]
    held = deliver.relations(spark, state, ROW)
    assert {(r["id"], r["v"], r["attempt"]) for r in deliver.delivered(spark, state, ROW).collect()} == {(i, "x", 3 if i == 3 else 1) for i in range(9) if i != 7}
    assert [(r["key"], r["attempt"], r["error"]) for r in held["quarantine"].collect()] == [("7", 3, "ValueError: no 7")] and held["waiting"].isEmpty()
    assert calls(folder) == sorted([(i, 1, "x") for i in range(9)] + [(i, a, "x") for i in (3, 7) for a in (2, 3)])


def test_replay(spark, tmp_path, folder, sink, monkeypatch):
    state, rows = f"{tmp_path}/state", spark.createDataFrame([(1, "x"), (3, "x")], ROW)

    def crash(*args, **named):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(deliver.io, "save_index", crash)
        with pytest.raises(KeyboardInterrupt):
            deliver.step(spark, rows, 0, ROW, "id", state, sink, 0.0)
    assert deliver.step(spark, rows, 0, ROW, "id", state, sink, 0.0)
    assert deliver.step(spark, rows, 0, ROW, "id", state, sink, 0.0)
    assert calls(folder) == [(1, 1, "x"), (3, 1, "x")]
    assert deliver.relations(spark, state, ROW)["done"].count() == 1


def test_newer_rows(spark, tmp_path, folder, sink):
    state = f"{tmp_path}/state"
    one = lambda *rows: spark.createDataFrame(rows, ROW)
    deliver.step(spark, one((3, "old"), (7, "old")), 0, ROW, "id", state, sink, 0.0, tries=1)
    assert deliver.relations(spark, state, ROW)["quarantine"].count() == 2
    good = sink_to(folder, lambda i, attempt: False)
    assert not deliver.step(spark, one((7, "new"), (7, "nev")), 1, ROW, "id", state, good, 1.0, order="v")
    assert [(r["id"], r["v"]) for r in deliver.delivered(spark, state, ROW).collect()] == [(7, "new")]
    assert [r["key"] for r in deliver.relations(spark, state, ROW)["quarantine"].collect()] == ["3"]
    assert not deliver.step(spark, one(), 2, ROW, "id", state, good, 1.0)


def test_stream_of_files(spark, tmp_path, sink):
    state, source, clock = f"{tmp_path}/state", f"{tmp_path}/in", iter(range(100)).__next__
    for part in ([(1, "a"), (3, "a")], [(1, "b"), (2, "b")]):
        spark.createDataFrame(part, ROW).write.mode("append").parquet(source)
        deliver.deliver_stream(spark, source, ROW, "id", state, f"{tmp_path}/c", sink, order="v", clock=clock).awaitTermination()
    deliver.drain(spark, ROW, "id", state, sink, clock=clock, sleep=lambda _: None)
    assert {(r["id"], r["v"], r["attempt"]) for r in deliver.delivered(spark, state, ROW).collect()} == {(1, "b", 1), (2, "b", 1), (3, "a", 3)}
