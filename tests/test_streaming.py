from pyspark.sql import functions as F

from sessiondeck.operators import context as ctx
from sessiondeck.sources import logs, tables
from sessiondeck.streaming import live

from . import samples

SF = "/root/testdata/sf0.001"


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()


def test_streaming_context_is_the_batch_one(spark, tmp_path):
    events = tables.user_events(spark, SF).select("sid", "seq", "type", "model")
    events.where("seq < 4").coalesce(1).write.parquet(str(tmp_path / "e"))
    events.where("seq >= 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    drain(live.streaming_context(source), "live_context")
    got = {tuple(r) for r in spark.table("live_context").select("sid", "seq", "turn_no", "active_model", "segment").collect()}
    want = {tuple(r) for r in ctx.with_context(tables.user_events(spark, SF)).select("sid", "seq", "turn_no", "active_model", "segment").collect()}
    assert got == want


def test_windows_and_gaps(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    drain(live.event_windows(source), "live_windows", "complete")
    want = {tuple(r) for r in live.event_windows(events).collect()}
    assert {tuple(r) for r in spark.table("live_windows").collect()} == want
    assert live.event_windows(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * events.count()
    assert live.gap_sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_live_logs(spark, tmp_path):
    samples.write(tmp_path, "in/p.jsonl", samples.jsonl(samples.PI) + '{"type":"message","id":"cut')
    drain(live.live_logs(spark, str(tmp_path / "in")), "live_logs")
    assert spark.table("live_logs").count() == 12


def test_appended_records_arrive_once(spark, tmp_path):
    """A log is followed while it grows, also from the middle of a record; another one appears meanwhile."""
    import json

    from sessiondeck.streaming import tail

    lines = [json.dumps(x) for x in samples.CLAUDE]
    text = "\n".join(lines) + "\n"
    folder = tmp_path / "logs"
    folder.mkdir()
    log = folder / "a.jsonl"
    cuts = [len("\n".join(lines[:3])) - 20, len("\n".join(lines[:4])) + 1, len(text)]
    query = tail.follow_logs(spark, str(folder)).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        seen = []
        for k, cut in enumerate(cuts):
            log.write_text(text[:cut])
            if k == 1:
                (folder / "b.jsonl").write_text("\n".join(json.dumps(x) for x in samples.PI))
            query.processAllAvailable()
            seen.append(spark.table("tailed").count())
    finally:
        query.stop()
    got = sorted((r["sid"], r["seq"], r["type"], r["id"]) for r in spark.table("tailed").collect())
    whole = logs.read_logs(spark, [f"{folder}/a.jsonl", f"{folder}/b.jsonl"])
    assert got == sorted((r["sid"], r["seq"], r["type"], r["id"]) for r in whole.collect()) and seen[0] < seen[1] < seen[2]
