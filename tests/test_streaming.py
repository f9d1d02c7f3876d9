import json

from pyspark.sql import functions as F

from quillspark.schemas import SCHEMAS
from quillspark.sources import adapters
from quillspark.streaming import events as S

SF = "/root/testdata/sf0.001"


def run(query):
    query.processAllAvailable()
    query.stop()


def test_replay_and_changes(spark, tmp_path):
    rows = [{"id": i, "job_id": f"j{i % 2}", "type": t, "timestamp": f"2026-01-01T00:00:{i:02d}Z", "message": "", "data": ""} for i, t in enumerate("aabbcca", 1)]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    run(S.replay(spark, str(tmp_path / "log"), after=2, job="j1").writeStream.format("memory").queryName("replayed").start())
    assert sorted(r.id for r in spark.table("replayed").collect()) == [3, 5, 7]
    run(S.changed(S.replay(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("changes").outputMode("append").start())
    assert sorted(r.id for r in spark.table("changes").collect()) == [1, 2, 3, 4, 5, 6, 7]
    S.numbered_sink(S.replay(spark, str(tmp_path / "log")).drop("id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "out")).collect()) == [*range(1, 8)]


def test_usage_stream_equals_batch(spark, tmp_path):
    usage = adapters.usage(spark, SF)
    usage.write.json(str(tmp_path / "usage"))
    stream = spark.readStream.schema(SCHEMAS["usage"]).json(str(tmp_path / "usage"))
    run(S.usage_report(stream).writeStream.format("memory").queryName("usage_stream").outputMode("complete").start())
    got = {(r.stage, r.model): (r.requests, r.total_tokens) for r in spark.table("usage_stream").collect()}
    want = {(r.stage, r.model): (r.requests, r.total_tokens) for r in S.usage_report(usage).collect()}
    assert got == want and got
    run(S.windowed_usage(stream).writeStream.format("memory").queryName("windows").outputMode("append").start())
    assert spark.table("windows").count() <= usage.select(F.window("recorded_at", "1 hour"), "stage").distinct().count()


def test_a_batch_written_again_gets_the_same_numbers(spark, tmp_path):
    def add(name, times):
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / name).write_text("\n".join(json.dumps({"id": 0, "job_id": "j", "type": "t", "timestamp": f"2026-01-01T00:00:{t:02d}Z", "message": "", "data": ""}) for t in times))

    def sink():
        S.numbered_sink(S.replay(spark, str(tmp_path / "log"), after=-1).drop("id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        return {(r.id, r.timestamp) for r in spark.read.json(str(tmp_path / "out")).collect()}

    add("1.json", [3, 1, 2])
    first = sink()
    add("2.json", [9, 4])
    both = sink()
    assert sorted(i for i, _ in both) == [1, 2, 3, 4, 5] and first < both
    (tmp_path / "cp" / "commits" / "1").unlink()  # as if the driver had been lost before it committed the second batch
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert sink() == both
