"""State of streams that expires, and the manifest of input files."""

import os

from shapelog.sources.logs import file_ranks, read_logs, stream_logs
from shapelog.streaming import streams

SENT = "x: D/JSIPCTypeSend JSIT Send ACTOR A MESSAGE M KIND Message TYPE "
DAYS, NEW = 12, 30


def daily_logs(folder):
    """A file a day: types and fallbacks of its own, and one of each that all share."""
    folder.mkdir()
    for day in range(DAYS):
        own = [f"{day:02}{i:03}" for i in range(NEW)] + ["shared"]
        lines = [f"{SENT}{{t{k}: number}}" for k in own] + [f"x: D/JSIPCSerializer UntypedFromJSVal fallback: f{k}" for k in own]
        path = folder / f"{day:02}.log"
        path.write_text("\n".join(lines * 2) + "\n")
        os.utime(path, (86400 * (1000 + day),) * 2)
    return str(folder)


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.table(name).collect(), held


def test_uses_expire(spark, tmp_path):
    stream = stream_logs(spark, daily_logs(tmp_path / "logs"), maxFilesPerTrigger=1)
    kept, all_held = run(spark, streams.stream_type_uses(stream), "kept_uses")
    assert len(kept) == DAYS * NEW + 1 == max(all_held)
    found, held = run(spark, streams.stream_type_uses(stream, expire="2 days"), "expiring_uses")
    assert max(held) <= 5 * (NEW + 1)
    types = [r.raw_type for r in found]
    assert set(types) == {r.raw_type for r in kept}
    again = types.count("{tshared: number}")
    assert 1 < again <= DAYS // 2 and len(types) == DAYS * NEW + again


def test_reports_by_period(spark, tmp_path):
    stream = stream_logs(spark, daily_logs(tmp_path / "logs"), maxFilesPerTrigger=1)
    found, held = run(spark, streams.stream_reports(stream, period="1 day")["fallbacks"], "daily_fallbacks")
    assert max(held) <= 3 * (NEW + 1)
    closed = {r.period.start for r in found}
    assert len(closed) == DAYS - 1  # the last day is still open
    assert {r.events for r in found} == {2} and len(found) == len(closed) * (NEW + 1)
    updated, _ = run(spark, streams.stream_reports(stream, period="1 day")["fallbacks"], "updated_fallbacks", "update")
    assert sum(r.events for r in updated if r.fallback == "fshared") == 2 * DAYS


def test_manifest_by_arguments(spark, tmp_path):
    folder = tmp_path / "b dir"
    folder.mkdir()
    for name in ("z+1", "a%2"):
        (folder / name).write_text("x\n")
    for name in ("c1.log", "c2.log", "a.log"):
        (tmp_path / name).write_text("x\n")
    paths = [str(folder), str(tmp_path / "c?.log"), str(tmp_path / "a.log"), str(tmp_path / "*.log")]
    found = file_ranks(spark, paths)
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.orderBy("file_rank", "file_path").collect()
    assert [(r.file_path.rsplit("/", 1)[1], r.file_rank) for r in rows] == [
        ("a%252", 0), ("z+1", 0), ("c1.log", 1), ("c2.log", 1), ("a.log", 2)
    ]
    scanned = read_logs(spark, paths).select("file_path").distinct()
    assert scanned.join(found, "file_path", "left_anti").count() == 0
    assert file_ranks(spark, paths[1]).count() == 2
