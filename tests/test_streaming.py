import json
import os

import pytest

from trajlake.sources.files import read_metric_stream, write_append_stream
from trajlake.streaming import stateful as st

SCHEMA = "env long, agent long, t long, reward double, terminal int, truncation int, x double, y double"


def put(folder, n, rows):
    names = ["env", "agent", "t", "reward", "terminal", "truncation", "x", "y"]
    (folder / f"{n:03d}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows))


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture(params=["in order", "reversed"])
def source(spark, tmp_path, request):
    folder = tmp_path / "in"
    folder.mkdir()
    # Two files, read one per micro-batch by their times: the episode and the gate both span them.
    put(folder, 0, [(0, 0, t, 1.0, 0, 0, 10.0 * t, 0.0) for t in range(3)] + [(1, 0, 0, 4.0, 1, 0, 0.0, 0.0)])
    put(folder, 1, [(0, 0, t, 2.0, int(t == 4), 0, 20.0 * t, 0.0) for t in range(3, 6)])
    early, late = (0, 1) if request.param == "in order" else (1, 0)
    os.utime(folder / f"{early:03d}.json", (1_000_000, 1_000_000))
    os.utime(folder / f"{late:03d}.json", (2_000_000, 2_000_000))
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
    return folder, reader.json(str(folder))


def test_gate_emits_means_and_resets(spark, source):
    got = run(spark, st.gated_metrics(source[1], "env", ["reward"], 5), "gated")
    assert [(r["env"], r["n"], r["reward"]) for r in got] == [(0, 6, 1.5)]


def test_gate_keeps_null_keys(spark, tmp_path):
    put(tmp_path, 0, [(None, 0, t, float(t), 0, 0, 0.0, 0.0) for t in range(4)])
    got = run(spark, st.gated_metrics(spark.readStream.schema(SCHEMA).json(str(tmp_path)), "env", ["reward"], 4), "gated_nulls")
    assert [(r["env"], r["n"], r["reward"]) for r in got] == [(None, 4, 1.5)]


def test_episodes_span_batches_in_any_order(spark, source):
    got = run(spark, st.episode_stream(source[1], ["env", "agent"], "t"), "episodes")
    assert sorted((r["env"], r["episode"], r["episode_return"], r["episode_length"]) for r in got) == [(0, 0, 7.0, 5), (1, 0, 4.0, 1)]


def test_displacement_state_spans_batches_in_any_order(spark, source):
    got = run(spark, st.displacement_stream(source[1], ["env"], "t", 45.0), "moved")
    # 0, 10, 20 | 60, 80, 100: kept are 0 and 60; taken the other way round it would have been 60 and 0 or 100.
    assert sorted((r["env"], r["t"]) for r in got) == [(0, 0), (0, 3), (1, 0)]


def test_replayed_steps_raise(spark, tmp_path):
    put(tmp_path, 0, [(0, 0, 0, 1.0, 0, 0, 0.0, 0.0)] * 2)
    with pytest.raises(Exception, match="came twice"):
        run(spark, st.episode_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path)), ["env", "agent"], "t"), "twice")


def test_metric_sink_and_append(spark, source, tmp_path):
    folder, _ = source
    stream = read_metric_stream(spark, str(folder), SCHEMA)
    st.metric_sink(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.count() == 7
    last = {r["env"]: (r["reward"], r["t"]) for r in st.latest_values(table, ["env"], "t", "reward").collect()}
    assert last == {0: (2.0, 5), 1: (4.0, 0)}
    write_append_stream(read_metric_stream(spark, str(folder), SCHEMA), str(tmp_path / "a"), str(tmp_path / "acp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7
