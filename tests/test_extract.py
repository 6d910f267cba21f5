"""Which line ends up in which table."""

import pytest
from pyspark.sql import functions as F

from shapelog.operators import extract
from shapelog.sources.logs import file_ranks, read_logs
from shapelog.operators.dedupe import distinct_type_uses
from shapelog.streaming.streams import type_events

SENT = "x: D/JSIPCTypeSend JSIT Send ACTOR {} MESSAGE {} KIND {} TYPE {}"
LOG = [
    SENT.format("A", "M", "Message", "any"),
    SENT.format("A", "M", "Message", "{a: string | null}"),
    SENT.format("A", "M", "Message", "NO VALUE"),
    SENT.format("A", "M", "Query", "FAILED"),
    SENT.format("A", "M", "Query", "FAILED"),
    SENT.format("Conduits", "CreateProxyContext", "Query", "any"),
    SENT.format("Conduits", "CreateProxyContext", "Message", "any"),
    SENT.format("A", "M", "QueryMore", "any"),  # no such kind
    SENT.format("A", "M", "Message", ""),  # no type
    "x: D/JSIPCTypeSend  JSIT Send ACTOR A MESSAGE M KIND Message TYPE any",  # not at the start
    "x: D/JSIPCTypeRecv JSIT Recv ACTOR A MESSAGE M KIND Message TYPE any",
    "x: D/JSIPCSerializer UntypedFromJSVal fallback: Foo /JSIPCValSend bar",
    "x: D/JSIPCSerializer an UntypedFromJSVal fallback: Foo",
    "x: D/JSIPCSerializer UntypedFromJSVal fallback: ",
    "x: D/JSIPCOther nothing",
    "Type checking failed: one",
    "x: D/JSIPCTypeChecking Type checking failed: Å\u0085 two",
    "x: D/JSIPCOther D/JSIPCTypeRecv D/JSIPCTypeSend late",
    "x: D/JSIPCTypeRecv",
]


@pytest.fixture
def records(lines):
    return extract.extract_records(lines(LOG)).cache()


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("mid").select(*columns).collect()]


def test_records(records):
    found = values(records, "mid", "module")
    assert [m for m, _ in found] == [*range(14), 16, 17]
    assert dict(found)[11] == "JSIPCSerializer"
    assert values(records, "module", "msg")[-1] == ("JSIPCTypeRecv", "D/JSIPCTypeSend late")


def test_type_events(records):
    events = extract.extract_type_events(records)
    assert [r[0] for r in values(events, "mid")] == [0, 1, 2, 3, 4, 5, 6]
    assert values(events, "kind")[3] == (1,)
    assert [r[0] for r in values(extract.malformed_events(records), "mid")] == [7, 8, 9]
    kept = extract.exclude_rules(
        extract.drop_failed(extract.drop_no_value(events)), extract_rules := [("Conduits", "CreateProxyContext", 1)]
    )
    assert [r[0] for r in values(kept, "mid")] == [0, 1, 6]
    spark = events.sparkSession
    rules = spark.createDataFrame(extract_rules + [("A", "M", None)], "actor string, message string, kind int")
    assert [r[0] for r in values(extract.exclude_rules(events, rules), "mid")] == [6]
    assert values(extract.failed_types(events), "actor", "message") == [("A", "M")] * 2


def test_malformed_stops_the_job_if_asked(records):
    with pytest.raises(Exception, match="Unknown JSIPCTypeSend: JSIT Send ACTOR A MESSAGE M KIND QueryMore"):
        extract.malformed_events(records, "FAILFAST").collect()


def test_ignored_actors_by_list_and_by_table(records):
    events = extract.extract_type_events(records)
    names = events.sparkSession.createDataFrame([("A",), ("B",)], "actor string")
    for listed in (["A", "B"], names):
        assert {r[0] for r in values(extract.ignore_actors(events, listed), "actor")} == {"Conduits"}
        seen = extract.ignored_actors_seen(events, listed).collect()
        assert [r["actor"] for r in seen] == ["A"]


def test_serializer_and_other_records(records):
    assert values(extract.fallback_events(records), "fallback") == [("Foo /JSIPCValSend bar",)]
    assert [r[0] for r in values(extract.serializer_events(records), "mid")] == [12, 13]
    assert values(extract.other_records(records), "text")[0][0].startswith("JSIPCTypeRecv: JSIT Recv")


def test_check_failures(lines):
    found = values(extract.extract_check_failures(lines(LOG)), "failure")
    assert found == [("one",), ("Å\u0085 two",)]


def test_value_events(lines):
    log = [
        "QQQ ACTOR A MESSAGE M CONTENTS {a: 1}",
        "QQQ ACTOR A MESSAGE  CONTENTS 1",
        "QQQ ACTOR x QQQ ACTOR B MESSAGE N CONTENTS QQQ ACTOR",
        "QQQ ACTOR A MESSAGE M CONTENTS ",
    ]
    found = extract.extract_value_events(lines(log))
    assert values(found, "actor", "message", "contents") == [
        ("A", "M", "{a: 1}"),
        ("B", "N", "QQQ ACTOR"),
    ]


def test_files_keep_their_bytes_and_their_order(spark, tmp_path):
    """Latin-1, all line ends, argument order, whatever the splits."""
    raw = [f"{{n{i % 50}: number}}".encode() for i in range(3000)]
    line = b"x: D/JSIPCTypeSend JSIT Send ACTOR A MESSAGE \xc3\x85 KIND Message TYPE "
    for name, part in (("b.log", raw[:1500]), ("a.log", raw[1500:])):
        (tmp_path / name).write_bytes(b"\r\n".join(line + t for t in reversed(part)) + b"\r\n")
    paths = [str(tmp_path / "b.log"), str(tmp_path / "a.log")]
    expected = None
    for size in ("128m", "16k", "3k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = read_logs(spark, paths)
            assert lines.filter(F.col("line").contains("Ã\u0085")).count() == 3000
            uses = distinct_type_uses(type_events(lines), file_ranks(spark, paths))
            order = [r[0] for r in uses.orderBy("first_seen").select("raw_type").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        expected = expected or order
        assert order == expected == [f"{{n{i}: number}}" for i in reversed(range(50))]
