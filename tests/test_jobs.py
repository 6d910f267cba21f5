"""Whole jobs, streams, nodes and values, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from shapelog.functions import literals
from shapelog.functions.typetext import parse_type, simplify_type, type_text, union_types
from shapelog.operators import nodes, unions, values
from shapelog.plans.discover import REPORTS, Options, discover, discover_lines, read_reports
from shapelog.plans.failures import failure_lines, find_failures
from shapelog.plans.infer import infer_schemas, report_lines
from shapelog.sources.logs import stream_logs
from shapelog.streaming import catalog as live
from shapelog.streaming import streams
from tests.test_type_text import random_type
from workloads import queries

SENT = "x: D/JSIPCTypeSend JSIT Send ACTOR {} MESSAGE {} KIND {} TYPE {}"


def fold(texts):
    united = None
    for text in texts:
        t = simplify_type(parse_type(text))
        united = t if united is None else union_types(united, t)
    return type_text(united)


@pytest.fixture(scope="module")
def typed_log():
    rng = random.Random(3)
    pool = [random_type(rng) for _ in range(60)]
    return [(rng.choice("AB"), rng.choice("MN"), rng.choice(pool)) for _ in range(800)]


def expected_catalog(typed_log):
    first = {}
    for i, (_, _, raw) in enumerate(typed_log):
        first.setdefault(raw, i)
    groups = {}
    for actor, message, raw in typed_log:
        groups.setdefault((actor, message), set()).add(raw)
    return {key: fold(sorted(raws, key=first.get)) for key, raws in groups.items()}


def test_discovery_over_split_files(spark, tmp_path, typed_log):
    """The union depends on the order of first appearance over all files."""
    log = [SENT.format(a, m, "Message", raw) for a, m, raw in typed_log]
    for name, part in (("z.log", log[:300]), ("a.log", log[300:])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    paths = [str(tmp_path / "z.log"), str(tmp_path / "a.log")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = discover(spark, paths, Options(overrides=False)).catalog.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["actor"], r["message"]): r["slot0"] for r in found} == expected_catalog(typed_log)


def test_discovery_reports(spark, lines, tmp_path):
    log = [
        SENT.format("A", "M", "Message", "number"),
        SENT.format("A", "M", "Message", "string"),
        SENT.format("A", "bad-", "Message", "Array<>"),
        SENT.format("A", "M", "Message", "FAILED"),
        SENT.format("I", "M", "Message", "any"),
        SENT.format("B", "M", "QueryReject", "any"),
        "x: D/JSIPCTypeSend garbage",
        "x: D/JSIPCSerializer UntypedFromJSVal fallback: a",
        "x: D/JSIPCSerializer UntypedFromJSVal fallback: b",
        "x: D/JSIPCSerializer UntypedFromJSVal fallback: b",
        "x: D/JSIPCSerializer note",
        "x: D/JSIPCTypeRecv hello",
    ]
    options = Options(ignore_errors=True, ignored=["I", "J"], overrides=[("C", "N:1", 1, "any", None, "c")])
    found = discover_lines(lines(log), options)

    def rows(df, *columns):
        return [tuple(r) for r in df.select(*columns).collect()]

    assert rows(found.catalog, "actor", "message", "slot0", "comment") == [
        ("A", "M", "number | string", ""), ("C", "N:1", "any", "c"),
    ]
    assert rows(found.combined, "input_ts", "combined_ts", "kind_label") == [
        ("number", "number | string", "sendAsyncMessage()"),
        ("string", "number | string", "sendAsyncMessage()"),
    ]
    assert rows(found.rejected_types, "raw_type") == [("Array<>",)]
    assert rows(found.rejected_messages, "actor", "message") == [("B", "M")]
    assert rows(found.malformed, "msg", "events") == [("garbage", 1)]
    assert rows(found.failed, "actor", "message") == [("A", "M")]
    assert rows(found.ignored, "actor") == [("I",)]
    assert rows(found.fallbacks, "fallback", "events") == [("b", 2), ("a", 1)]
    assert rows(found.serializer, "msg", "events") == [("note", 1)]
    assert rows(found.others, "text") == [("JSIPCTypeRecv: hello",)]
    assert rows(found.name_chars, "actor_chars", "message_chars") == [("none", ":")]
    path = str(tmp_path / "reports")
    found.write_reports(path)
    written = read_reports(spark, path)
    assert set(written) == set(REPORTS)
    for name, report in written.items():
        assert rows(report, *report.columns) == rows(getattr(found, name), *report.columns), name
    for bad in (log[2], log[5], log[6]):
        with pytest.raises(Exception, match="Syntax error|reject type|Unknown JSIPCTypeSend"):
            discover_lines(lines([log[0], bad])).catalog.collect()


def test_find_failures(spark, tmp_path):
    for name, text in (("log a+1", "b"), ("log a 2", "a"), ("log a%3", None)):
        line = f"x Type checking failed: {text}\n" * 2 if text else "nothing\n"
        (tmp_path / name).write_text(line + ("Type checking failed: b\n" if name == "log a 2" else ""))
    found = find_failures(spark, [str(tmp_path / n) for n in ("log a+1", "log a 2", "log a%3")])
    assert [r["line"] for r in failure_lines(found).collect()] == ["a", "   2", "b", "   2", "  +1"]


def test_streams_equal_batch(spark, tmp_path, typed_log, lines):
    log = [SENT.format(a, m, "Message", raw) for a, m, raw in typed_log]
    log += ["x: D/JSIPCSerializer UntypedFromJSVal fallback: f", "Type checking failed: t"] * 3
    logs = tmp_path / "logs"
    logs.mkdir()

    def add(number):
        part = log[number * 300 : (number + 1) * 300]
        (logs / f"{number}.log").write_text("\n".join(part) + "\n")

    store = str(tmp_path / "store")
    for number in range(3):
        add(number)
        stream = stream_logs(spark, str(logs))
        live.stream_catalog(stream, store, str(tmp_path / "checkpoint")).awaitTermination()
    expected = expected_catalog(typed_log)
    found = live.stored_catalog(spark, store).collect()
    assert {(r["actor"], r["message"]): r["slot0"] for r in found} == expected

    # A batch that is run again changes nothing.
    last = [r["line"] for r in spark.read.text(str(logs / "2.log")).selectExpr("value AS line").collect()]
    live.update_catalog(lines(last).drop("mid"), 2, store)
    again = live.stored_catalog(spark, store).collect()
    assert {(r["actor"], r["message"]): r["slot0"] for r in again} == expected

    def run(stream, mode, name):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode)
        query.trigger(availableNow=True).start().awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    stream = stream_logs(spark, str(logs), maxFilesPerTrigger=1)
    uses = run(streams.stream_type_uses(stream), "append", "uses")
    assert sorted(uses) == sorted({(raw, a, m, 0) for a, m, raw in typed_log})
    reports = streams.stream_reports(stream)
    assert run(reports["fallbacks"], "complete", "fallbacks") == [("f", 3)]
    assert run(reports["failures"], "complete", "failures")[0][::2] == ("t", 3)


def test_always_merging_union_covers_the_ordered_one(spark):
    """Each place of an ordered union is a place of the merged one."""
    rng = random.Random(11)
    rows = [(g, i, random_type(rng)) for g in range(12) for i in range(4)]
    raw = spark.createDataFrame(rows, "g int, i int, raw_type string")
    typed = raw.join(unions.simplify_types(raw), "raw_type")
    united = unions.union_types(typed, keys=["g"], order=["i"])
    texts = united.select("g", united["type_ts"].alias("text"))
    parsed = texts.join(unions.parse_types(texts, "text"), "text")
    ordered = nodes.type_nodes(parsed.select("g", "type_state"))
    merged = nodes.merge_nodes(nodes.type_nodes(typed.select("g", "type_state")), ["g"])
    places = {(r["g"], r["path"]): set(r["tags"]) for r in merged.collect()}
    for r in ordered.collect():
        assert r["tag"] in places[r["g"], r["path"]]
    texts = {r["g"]: r["type_ts"] for r in nodes.merged_types(merged, ["g"]).collect()}
    by_group = {g: [t for h, _, t in rows if h == g] for g in texts}
    # Where no two unlike objects meet, both unions are the same text.
    same = [g for g, found in by_group.items() if fold(found).count("{") == texts[g].count("{")]
    assert same and all(fold(by_group[g]) == texts[g] for g in same)


def test_discovery_scans_the_log_once(spark, tmp_path, typed_log):
    """All reports read what the one pass over the log left, each its own route."""
    path = tmp_path / "log"
    path.write_text("\n".join(SENT.format(a, m, "Message", raw) for a, m, raw in typed_log) + "\n")
    found = discover(spark, [str(path)], Options(ignore_errors=True, overrides=False))
    path.write_text("")
    for name in REPORTS:
        report = getattr(found, name)
        if report is not None:
            assert "FileScan text" not in report._jdf.queryExecution().toString()
            report.collect()
    assert "PartitionFilters: [isnotnull(route" in found.failed._jdf.queryExecution().toString()


def test_nodes_of_deep_types(spark):
    """Any depth in a plan of one size, and no job while it is made."""
    deep = "Array<" * 30 + "{a: Map<string, number | Set<null>>; 'b c'?: {}; 7: any}" + ">" * 30
    raw = spark.createDataFrame([(deep,), ("number",), ("{a: {b: {c: number}}}",), ("no type <",)], "raw_type string")
    typed = unions.parse_types(raw).select("raw_type", "type_state")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = nodes.type_nodes(typed)
    assert len(tracker.getJobIdsForGroup(None)) == before
    rows = {(r.raw_type[:5], r.path, r.tag): r for r in found.collect()}
    inside = "$" + "[]" * 30
    assert rows["numbe", "$", "number"].parent_path is None
    assert rows["{a: {", "$.a.b.c", "number"].parent_at == "0.0.0"
    assert {p.removeprefix(inside): t for n, p, t in rows if n == "Array" and p.startswith(inside + ".") and p[-1] != "}"} == {
        ".a": "map", '."b c"': "object", ".7": "any", ".a{v}<>": "null",
    }
    assert rows["Array", inside + ".a{v}", "set"].pos == 1 and rows["Array", inside + '."b c"', "object"].optional
    assert not [n for n, _, _ in rows if n == "no ty"]
    assert nodes.type_nodes(typed.filter("false")).count() == 0


def test_parsing_is_spread(spark):
    """The distinct texts are dealt out to as many tasks as shuffles have parts."""
    raw = spark.range(2000).selectExpr("concat('{a', id, ': number}') AS raw_type")
    plan = unions.parse_types(raw)
    assert plan.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert plan.filter("error IS NULL").count() == 2000


LITERALS = [
    "NaN", "{pattern:/a\\/b \" c/}", "{'on':false}", '"say \\"hi\\""', "-3.25", "(void 0)",
    "({ names : [], sizes : [4,] , tags: [7,8] })", "null", "{}", "[]", "-12",
    "{ rows : [{key:99, at:1}, 5, 'p', true] }", "({since:(new Date(8))})",
    "{new: 4}", "{10: 1, 11: 2}", '{"k": 69, "k2": 70, 5: 6}', '{"a 1 , 2": [3], "": ""}',
    "[void 0, 1]", "[1, void 0]", "{t: -2.5E3}", '{"q": "\'", "r": \'"\'}', "[3, [4], 'z']",
    "new Foo(1)", "- 7", "8-2", "[4 5]", "[,]", "{p:1,}", "{p:1, p:2}", "1e5", "'never closed", "\u0001", "b",
    "{false: 0}", '"p" "q"', "//", "[/x/, /y/]",
]


def test_skeletons_keep_the_type(spark):
    df = spark.createDataFrame([(s,) for s in LITERALS], "contents string")
    from pyspark.sql import functions as F

    found = df.withColumn("skeleton", values.payload_skeleton(F.col("contents"))).collect()

    def typed(text):
        try:
            return literals.value_type_text(literals.value_type(literals.read_literal(text)))
        except literals.LiteralError:
            return None

    for row in found:
        assert typed(row["skeleton"]) == typed(row["contents"]), row
    assert len({r["skeleton"] for r in found}) < len(LITERALS)


def test_payloads(spark):
    df = spark.createDataFrame([(s,) for s in [*LITERALS, None]], "contents string")
    found = {r["contents"]: r for r in values.parse_payloads(df).collect()}
    assert found['{"k": 69, "k2": 70, 5: 6}']["value"] == '{"k": 69, "k2": 70, "5": 6}'
    assert found["(void 0)"]["value"] == '{"$type": "undefined", "text": "undefined"}'
    assert found["new Foo(1)"]["error"] == "Unknown constructor Foo"
    assert found["1e5"]["error"] == "1: Syntax error at e5"
    assert found[None]["value"] is None and found[None]["error"] is None
    with pytest.raises(Exception, match="Unknown constructor|Syntax error|Bad character|repeated"):
        values.parse_payloads(df, mode="FAILFAST").collect()


def test_values_keep_all_labels():
    shown = lambda text: literals.literal_json(literals.read_literal(text))
    assert shown("{1: 'a', \"1\": 'b'}") == '{"$type": "object", "entries": [[1, "a"], ["1", "b"]]}'
    assert shown("{'$type': 3}") == '{"$type": "object", "entries": [["$type", 3]]}'


def test_maps_in_one_array_keep_their_own_types(spark, lines):
    log = ["QQQ ACTOR A MESSAGE M CONTENTS [{'x': 1}, {1: true}]"]
    from shapelog.operators.extract import extract_value_events

    payloads = values.distinct_payloads(extract_value_events(lines(log)))
    found = values.detect_map_objects(values.distinct_value_types(values.infer_value_types(payloads)))
    assert sorted((r["key_type"], r["value_type"]) for r in found.collect()) == [("number", "bool"), ("string", "number")]


def test_rejected_values_are_listed(spark, lines):
    from shapelog.plans.infer import rejected_values

    log = ["QQQ ACTOR A MESSAGE M CONTENTS new Foo(0 , 'b')", "QQQ ACTOR A MESSAGE M CONTENTS {}"]
    (bad,) = rejected_values(lines(log)).collect()
    assert bad["contents"] == "new Foo(0 , 'b')" and "new Foo(0 , 'b')" in bad["error"] and bad["mid"] == 0


UNITED = [
    (["1", "2", "true"], ["bool | number"]),
    (["1", "{x: 1}", "{x: 2}"], ["number | {x: number}"]),
    (["{x: 1}", "{x: 'a', y: 1}"], ["{x: number | string, y?: number}"]),
    (["{x: {p: 1}}", "{x: {q: 1}}", "{x: 1}"], ["{x: number | {p?: number, q?: number}}"]),
    (["{x: []}", "{x: 1}"], ["{x: Array()}", "{x: number}"]),
    (["[]", "[1]", "['a']", "[{a: 1}]"], ["Array(number, string, {a: number})"]),
    (["{'a': 1}", "{'b': 2, 'c': 3}", "{'a': true}"],
     ["ObjMap(string, bool)", "ObjMap(string, number)"]),
    (["{a: 1, b: 2}", "{b: 3, a: 4}"], ["{a: number, b: number}"]),
]


def test_value_report(spark, lines):
    log = [
        f"QQQ ACTOR A{i} MESSAGE M CONTENTS {payload}"
        for i, (payloads, _) in enumerate(UNITED)
        for payload in payloads
    ]
    log += ["QQQ ACTOR DevToolsFrame MESSAGE DevToolsFrameChild:packet CONTENTS oops"]
    report = infer_schemas(lines(log))
    found = {}
    for r in report.collect():
        found.setdefault(r["actor"], []).append(r["type_text"])
    assert found == {f"A{i}": types for i, (_, types) in enumerate(UNITED)}
    printed = [r["line"] for r in report_lines(report).collect()]
    assert printed[:3] == ["A0", "  M bool | number", ""]
    assert printed[-7:] == [
        "A6", "  M", "    ObjMap(string, bool)", "    ObjMap(string, number)", "",
        "A7", "  M {a: number, b: number}", "",
    ][-7:]
    strict = infer_schemas(lines(log), strict=True)
    assert strict.filter("actor = 'A0'").count() == 2
    with pytest.raises(ValueError, match="while parsing"):
        infer_schemas(lines(["QQQ ACTOR A MESSAGE M CONTENTS oops"]))


def test_shapes_merge(spark):
    pairs = [("", "a", True), ("a", "b", False), ("ab", "bc", False), ("abc", "bcd", True),
             ("abc", "abcdefgh", True), ("ab", "bcde", False)]
    rows = [(list(a), list(b)) for a, b, _ in pairs]
    df = spark.createDataFrame(rows, "names_a array<string>, names_b array<string>")
    found = [r["mergeable"] for r in nodes.mergeable_shapes(df).collect()]
    assert found == [expected for *_, expected in pairs]


def test_declaration_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "files")
    monkeypatch.setattr(queries, "scratch", lambda spark, name: path)
    read = queries.s3_read_declarations(spark, "/root/testdata/sf0.001")
    parts = {f.name.split("-")[1] for f in (tmp_path / "files").rglob("part-*.txt")}
    assert len(parts) > 1
    assert read.count() == spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").count()


def test_halves_of_a_log_are_more_tasks_than_two(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    rows = spark.range(4000).selectExpr("id AS line_no", "CAST(id AS STRING) AS line")
    batches = []

    def start(lines, store, checkpoint):
        def keep(batch, number):
            numbered = batch.withColumn("mid", F.monotonically_increasing_id())
            batches.append([int(r.line) for r in numbered.orderBy("file_path", "mid").collect()])

        writer = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        return writer.foreachBatch(keep).start()

    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        queries.in_halves(spark, rows, start, str(tmp_path / "store"))
    finally:
        spark.conf.unset(coalesce)
    assert len(list((tmp_path / "lines").glob("part-*.txt"))) > 4
    assert batches == [list(range(2000)), list(range(2000, 4000))]
