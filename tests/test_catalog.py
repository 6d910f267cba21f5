"""Kinds, overrides, declarations, sinks."""

import json

import pytest

from shapelog.operators import catalog as cat
from shapelog.operators import writers
from shapelog.operators.declare import parse_declarations
from shapelog.plans.translate import declared_catalog, translate_declarations
from shapelog.sources.overrides import override_rows, read_overrides

BOTH = "Message M of actor A has both message and query types."
REJECT = (
    "Message M of actor A has a query reject type but not a query resolve type, "
    "which we can't really represent."
)


KINDS = (
    [
        ("A", [0], ["any", None], None),
        ("A", [1], ["any", None], None),
        ("A", [2], [None, "any"], None),
        ("A", [2, 3], [None, "any"], None),
        ("A", [1, 2], ["any", "any"], None),
        ("A", [1, 2, 3], ["any", "any"], None),
        ("A", [0, 1], None, BOTH),
        ("A", [0, 2], None, BOTH),
        ("A", [0, 3], None, BOTH),
        ("A", [3], None, REJECT),
        ("A", [1, 3], None, REJECT),
        ("TestWindow", [3], [None, "never"], None),
        ("TestProcessActor", [1, 3], ["any", "never"], None),
    ]
)


def test_kinds(spark):
    rows = [
        (actor, f"M{i}", k, "any", '"any"')
        for i, (actor, kinds, _, _) in enumerate(KINDS)
        for k in kinds
    ]
    schema = "actor string, message string, kind int, type_ts string, type_json string"
    pivoted = cat.unify_kinds(spark.createDataFrame(rows, schema))
    found = {r["message"]: r for r in pivoted.collect()}
    for i, (_, kinds, slots, error) in enumerate(KINDS):
        row = found[f"M{i}"]
        assert row["error"] == (error and error.replace("Message M ", f"Message M{i} "))
        if error is None:
            assert [row["slot0"], row["slot1"]] == slots
            assert row["arity"] == (1 if kinds == [0] else 2)
    good = {r["message"] for r in cat.build_catalog(pivoted).collect()}
    assert good == {f"M{i}" for i, (*_, error) in enumerate(KINDS) if error is None}
    with pytest.raises(Exception, match="of actor A has"):
        cat.build_catalog(pivoted, "FAILFAST").collect()


def catalog(spark, rows):
    schema = (
        "actor string, message string, arity int, slot0 string, slot1 string, "
        "slot0_json string, slot1_json string, comment string"
    )
    full = [(a, m, n, s0, s1, s0 and f'"{s0}"', s1 and f'"{s1}"', c) for a, m, n, s0, s1, c in rows]
    return spark.createDataFrame(full, schema)


FOUND = [
    ("A", "M", 1, "null", None, ""),
    ("A", "Q", 2, "null", "null", ""),
    ("B", "M", 1, "null", None, ""),
    ("C", None, 1, "any", None, ""),
]


def overridden(spark, rows):
    laid = cat.typed_overrides(read_overrides(spark, rows))
    found = catalog(spark, FOUND)
    applied = cat.apply_overrides(found, laid).select("actor", "message", "slot0", "slot1", "comment")
    errors = cat.validate_overrides(found, laid)
    return [tuple(r) for r in applied.collect()], {(r[0], r[1]): r[2] for r in errors.collect()}


def test_overrides(spark):
    rows, errors = overridden(
        spark,
        [
            ("A", "Q", 2, None, "any", "c1"),
            ("B", None, 1, "testOnly", None, ""),
            ("C", "N", 1, "{ a: string }", None, "c2"),
            ("D", "N", 2, None, "any", "c3"),
        ],
    )
    assert rows == [
        ("A", "M", "null", None, ""),
        ("A", "Q", "null", "any", "c1"),
        ("B", None, "testOnly", None, ""),
        ("C", "N", "{a: string}", None, "c2"),
        ("D", "N", None, "any", "c3"),
    ]
    assert errors == {}


def test_bad_overrides(spark):
    _, errors = overridden(
        spark,
        [
            ("A", "M", 2, "any", None, "c"),
            ("A", "Q", 2, None, None, "c"),
            ("B", "M", 1, "any", None, ""),
            ("C", None, 1, "any", None, ""),
        ],
    )
    assert errors == {
        ("A", "M"): 'type ["null"] and override ["any", "never"] must have the same length',
        ("A", "Q"): "Expected a type in query override",
        ("B", "M"): 'override type ["any"] must have a comment',
        ("C", None): "Non-testOnly single actor override types need a comment",
    }
    with pytest.raises(Exception, match="Syntax error"):
        overridden(spark, [("A", "M", 1, "Array<>", None, "c")])


def test_default_overrides(spark):
    laid = cat.typed_overrides(read_overrides(spark))
    assert laid.count() == len(override_rows()) == 34
    rows = {(r["actor"], r["message"]): r for r in laid.collect()}
    listener = rows["Conduits", "RunListener"]
    assert listener["slot1"] == "Array<structuredClone | undefined> | structuredClone | undefined"


def declared(body, head="type MessageTypes = "):
    return f"{head}{{ {body} }};"


GOOD = [
    (declared("Clock: { Tick: number };"), {"Clock": {"Tick": ["number"]}}),
    (
        declared("Clock: { Tick: number }, $Door_2: { 'Open:now-': null };", "type MessageTypes = // two\n"),
        {"$Door_2": {"Open:now-": ["null"]}, "Clock": {"Tick": ["number"]}},
    ),
    (declared('Door: /* both */ { Shut: null; "Lock:a": string };'), {"Door": {"Lock:a": ["string"], "Shut": ["null"]}}),
    (declared("Lamp: { Ask: (_: string) => boolean };"), {"Lamp": {"Ask": ["string", "boolean"]}}),
    (declared("Lamp: { Wait: (_: never) => Array<{ on: boolean }> };") + ";",
     {"Lamp": {"Wait": ["never", ["array", ["object", ["on", "boolean"]]]]}}),
    (declared("Lamp: { Put: (number | string), Get: (_: (null)) => number }"),
     {"Lamp": {"Put": [["union", "number", "string"]], "Get": ["null", "number"]}}),
    (declared("Radio: any, Tape: testOnly"), {"Radio": "any", "Tape": "testOnly"}),
]


def test_declarations(spark):
    files = [(str(i), text) for i, (text, _) in enumerate(GOOD)]
    rows = parse_declarations(spark.createDataFrame(files, "file string, text string")).collect()
    found = [{} for _ in GOOD]
    for r in rows:
        assert r["error"] is None
        slots = [json.loads(s or '"never"') for s in (r["slot0_json"], r["slot1_json"])]
        actors = found[int(r["file"])]
        if r["message"] is None:
            actors[r["actor"]] = slots[0]
        else:
            actors.setdefault(r["actor"], {})[r["message"]] = slots[: r["arity"]]
    assert found == [expected for _, expected in GOOD]


ACTOR_RULE = "should be a valid identifier"
MESSAGE_RULE = f'{ACTOR_RULE} (it can also contain "-" or ":" after the first character)'
BAD = [
    ("// a\n// b\nlet MessageTypes = { Lamp: any };", '3: Expected actor declarations to start with "type", not "let"'),
    ("\ntype Messages = { Lamp: any };", '2: Expected top level type name to be "MessageTypes", not "Messages"'),
    ("type", '0: Syntax error near "???"'),
    ("\n77", '2: Syntax error near "77"'),
    *[(declared(f"\n'{n}': {{ Tick: null }};"), f'2: Actor name "{n}" {ACTOR_RULE}') for n in ("my lamp", "9Lamp", "La:mp", "La-mp")],
    *[(declared(f"\nLamp: {{ '{n}': null }};"), f'2: Message name "{n}" {MESSAGE_RULE}') for n in (" Tick", "9Tick", "-Tick", ":Tick")],
    (declared("\n\nLamp: { Off: (_: never) => never };"),
     '3: Message type must have a non-"never" type to either the left or right of the arrow'),
    (declared("\nLamp: string"), '2: Syntax error near "string"'),
]


def test_bad_declarations(spark):
    files = [(str(i), text) for i, (text, _) in enumerate(BAD)]
    rows = parse_declarations(spark.createDataFrame(files, "file string, text string")).collect()
    assert {r["file"]: r["error"] for r in rows} == {
        str(i): f"{i}:{error}" for i, (_, error) in enumerate(BAD)
    }


TWICE = [
    (declared("\nLamp: { On: null };\n\nLamp: { Off: null };"),
     "0:4: Multiple declarations of actor Lamp. Previous was at 0:2"),
    (declared("\n'Door': { On: null };\n\"Door\": { On: null };"),
     "1:3: Multiple declarations of actor Door. Previous was at 1:2"),
    (declared("\nBell: { Ring: null;\n Ring: (_: string) => null };"),
     "2:3: Multiple declarations of message Ring for actor Bell. Previous was at 2:2"),
    (declared("\nHorn: {\nBlow: null,\nBlow: string; Stop: null };"),
     "3:4: Multiple declarations of message Blow for actor Horn. Previous was at 3:3"),
    (declared("\n\nLamp: any"), "4:3: Multiple declarations of actor Lamp. Previous was at 0:2"),
]


def test_repeated_declarations(spark):
    files = [(i, str(i), text) for i, (text, _) in enumerate(TWICE)]
    _, errors = declared_catalog(spark.createDataFrame(files, "file_rank bigint, file string, text string"))
    assert sorted(r["error"] for r in errors.collect()) == sorted(error for _, error in TWICE)


def test_translate_files(spark, tmp_path):
    (tmp_path / "b.ts").write_text("type MessageTypes = { B: any };", encoding="utf8")
    (tmp_path / "a.ts").write_text("type MessageTypes = { A: { 'm:1': Array<number> } };")
    paths = [str(tmp_path / n) for n in ("b.ts", "a.ts")]
    translate_declarations(spark, paths, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text() == (
        '{\n  "A": {\n    "m:1": [["array", "number"]]\n  },\n  "B": "any"\n}\n'
    )
    (tmp_path / "c.ts").write_text("type MessageTypes =\n{ B: testOnly };")
    with pytest.raises(ValueError, match=r"c.ts:2: Multiple declarations of actor B. Previous was at .*b.ts:1"):
        translate_declarations(spark, [*paths, str(tmp_path / "c.ts")], str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists()


def test_first_error_by_argument_and_line(spark, tmp_path):
    """Arguments z, b, a: the first error is that of z, and line 2 comes before line 10."""
    files = {
        "z.ts": "type MessageTypes = {" + "\n" * 9 + " Lamp: any,\n Lamp: any };",
        "b.ts": "type MessageTypes = { Lamp: any };",
        "a.ts": "type MessageTypes = !",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in files]
    with pytest.raises(ValueError, match=r"z.ts:11: Multiple declarations of actor Lamp"):
        translate_declarations(spark, paths, str(tmp_path / "out"))
    rows = [(0, "x", "type MessageTypes =\n{ A: any,\n" + "\n" * 7 + "A: any,\n B: { M: null,\n M: null } };")]
    _, errors = declared_catalog(spark.createDataFrame(rows, "file_rank bigint, file string, text string"))
    assert [r["line"] for r in errors.collect()] == sorted(r["line"] for r in errors.collect())


def test_rejects_keep_their_file(spark):
    files = spark.createDataFrame([("f", "type MessageTypes = {"), ("g", "%")], "file string, text string")
    found = {r["file"]: r["error"] for r in parse_declarations(files).collect()}
    assert found == {"f": 'f:0: Syntax error near "???"', "g": "0: Bad character %"}
    with pytest.raises(Exception, match="Syntax error|Bad character"):
        parse_declarations(files, "FAILFAST").collect()


ROWS = [
    ("B", "M", 1, "any", None, ""),
    ("A", "A1:M1", 2, "any", None, ""),
    ("A", "x", 2, None, "any", "why"),
    ("C", None, 1, "testOnly", None, "all"),
]


def text_of(lines):
    return "".join(r["line"] + "\n" for r in lines.collect())


def test_documents(spark):
    rows = catalog(spark, ROWS)
    assert text_of(writers.ts_lines(rows)) == (
        'type MessageTypes = {\n  A: {\n    "A1:M1": (_: any) => never;\n    // why\n'
        "    x: (_: never) => any;\n  };\n  B: {\n    M: any;\n  };\n  // all\n  C: testOnly;\n};\n"
    )
    assert text_of(writers.json_lines(rows)) == (
        '{\n  "A": {\n    "A1:M1": ["any", "never"],\n    "x": ["never", "any"]\n  },\n'
        '  "B": {\n    "M": ["any"]\n  },\n  "C": "testOnly"\n}\n'
    )
    assert text_of(writers.text_lines(rows)) == (
        "A\n  A1:M1 : (_: any) => never\n  // why\n  x : (_: never) => any\n\nB\n  M : any\n\n"
        "// all\nC\n  testOnly\n\n"
    )
