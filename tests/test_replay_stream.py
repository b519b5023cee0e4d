"""Replay as a stateful stream: what the batch form gives, whatever the order of arrival."""

import json
import random

from arbora.streaming.replay import replay, replay_stream


def test_stream_equals_batch_on_shuffled_arrival(spark, tmp_path):
    r = random.Random(3)
    rows = [{"seq": k, "t": k / 2, "name": r.choice("abcdef"), "fp": f"v{k}", "error": None} for k in range(200)]
    rows[150:] = [{**x, "name": "late"} for x in rows[150:]]  # all after the time asked for
    kind, at = "seq long, t double, name string, fp string, error string", 60.0
    want = {(x["name"], x["seq"], x["fp"]) for x in replay(spark.createDataFrame(rows, kind), at).collect()}
    mixed = rows[:]
    r.shuffle(mixed)
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in mixed[k::4]))
    (tmp_path / "in" / "9.json").write_text(json.dumps({"seq": 900, "t": 90_000.0, "name": "end", "fp": "x"}) + "\n")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = replay_stream(stream, at, "1 hour").writeStream.outputMode("append").format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        q.stop()
        got = {(x["name"], x["seq"], x["fp"]) for x in spark.table("replayed").collect()}
    finally:
        spark.conf.unset(key)
    assert got == want and len(want) >= 6
