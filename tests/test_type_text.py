"""Reading, printing, simplifying and uniting types."""

import random

import pytest

from shapelog.functions.typetext import (
    TypeTextError,
    parse_type,
    read_state,
    simplify_type,
    type_json,
    type_state,
    type_text,
    union_types,
)
from shapelog.functions.vocabulary import PRIMITIVES

# One text for each rule of reading and printing; the forms follow from the rules.
PRINTED = [
    ("string // trailing", "string", '"string"'),
    ("// leading\n\n  null", "null", '"null"'),
    ("/* a ** b */ number /* c */", "number", '"number"'),
    ("Set<Array<Set<boolean>>>", "Set<Array<Set<boolean>>>", '["set", ["array", ["set", "boolean"]]]'),
    ("Map<string,Map<number,null>>", "Map<string, Map<number, null>>",
     '["map", "string", ["map", "number", "null"]]'),
    # Members keep their order in JSON, nested to the left; the text sorts them.
    ("string | number | boolean", "boolean | number | string",
     '["union", ["union", "string", "number"], "boolean"]'),
    ("Set<string> | Array<string>", "Array<string> | Set<string>", '["union", ["set", "string"], ["array", "string"]]'),
    ("| undefined", "undefined", '"undefined"'),
    ("| null | string", "null | string", '["union", "null", "string"]'),
    ("(boolean | (null)) | string", "boolean | null | string",
     '["union", ["union", "boolean", "null"], "string"]'),
    ("Array<{}>", "Array<{}>", '["array", ["object"]]'),
    ("{height: number; width: number;}", "{height: number; width: number}",
     '["object", ["height", "number"], ["width", "number"]]'),
    ("{left?: number, right: number}", "{left?: number; right: number}",
     '["object", ["left", "number", true], ["right", "number"]]'),
    # Names that are integers come last, by value, and stay integers.
    ("{z: null; -7: null; 30: null}", "{z: null; -7: null; 30: null}",
     '["object", ["z", "null"], [-7, "null"], [30, "null"]]'),
    ("{string: string}", "{string: string}", '["object", ["string", "string"]]'),
    ('{"two words": null}', '{"two words": null}', '["object", ["two words", "null"]]'),
    (r"{'don\'t': null}", '{"don\'t": null}', '["object", ["don\'t", "null"]]'),
] + [(p, p, f'"{p}"') for p in PRIMITIVES]

REJECTED = [
    ("{7up: null}", '???:1: Syntax error near "up"'),
    ("Map<string>", '???:1: Syntax error near ">"'),
    ("Array<>", '???:1: Syntax error near ">"'),
    ("{-3000000000: null}", "1: Integer -3000000000 is too small"),
    ("{3000000000: null}", "1: Integer 3000000000 is too large"),
    ("null string", '???:1: Syntax error near "string"'),
    ("{Map: null}", '???:1: Syntax error near "Map"'),
    ("\n\nMap<null, ", '???:0: Syntax error near "???"'),
    ("null ^", "5: Bad character ^"),
    ("{w: null; v: null}", '???:1: Property "v" is out of order or repeated'),
    ("{v: null; v: string}", '???:1: Property "v" is out of order or repeated'),
]


def shape(names, t="null"):
    return "{" + "; ".join(f"{n}: {t}" for n in names) + "}"


UNITED = [
    (["{w: string; z: null}", "{w: number}"], "{w: number | string; z?: null}"),
    (["{w: string}", "{v: null; w: any}"], "{v?: null; w: any}"),
    (["{w: number | null}", "{w: null | number}"], "{w: null | number}"),
    (["never", "Set<null>"], "Set<null>"),
    (["Set<null>", "never"], "Set<null>"),
    # The third joins the first, and then takes in the second.
    ([shape("m"), shape("n"), shape("mn")], "{m?: null; n?: null}"),
    (["{m: null} | {n: null}", "string | {m: null; n: null}"], "string | {m?: null; n?: null}"),
    # Of overlapping shapes those that come first decide.
    ([shape("pqr"), shape("qrs"), shape("rst")], "{p?: null; q: null; r: null; s?: null} | {r: null; s: null; t: null}"),
    ([shape("rst"), shape("qrs"), shape("pqr")], "{p: null; q: null; r: null} | {q?: null; r: null; s: null; t?: null}"),
    (["Set<number>", "Array<any>", "Set<boolean>"], "Array<any> | Set<boolean | number>"),
    (["Map<number, null>", "Map<number, string>"], "Map<number, null | string>"),
    (["testOnly", "testOnly"], "testOnly"),
    (["Array<null> | boolean", "any"], "any"),
]

SIMPLIFIED = [
    ("{m: null} | {m: null; n: null} | {o: null}", "{m: null; n?: null} | {o: null}"),
    ("null | {o: null}", "null | {o: null}"),
    ("Set<Set<{m: null} | {m: null; n: null}> | null>", "Set<Set<{m: null; n?: null}> | null>"),
    ("Map<string, Array<{m: null} | {m: null; n: null}> | null>", "Map<string, Array<{m: null; n?: null}> | null>"),
    ("{o: {m: null} | {m: null; n: null}}", "{o: {m: null; n?: null}}"),
    ("null | null", "null"),
    # One pass: what the first has taken in does not meet the second again.
    ("{m: null} | {n: null} | {m: null; n: null; o: null}", "{m: null; n?: null; o?: null} | {n: null}"),
]


@pytest.mark.parametrize("text, printed, json", PRINTED)
def test_print(text, printed, json):
    parsed = parse_type(text)
    assert (type_text(parsed), type_json(parsed)) == (printed, json)
    assert read_state(type_state(parsed)) == parsed


@pytest.mark.parametrize("text, error", REJECTED)
def test_reject(text, error):
    with pytest.raises(TypeTextError) as caught:
        parse_type(text)
    assert caught.value.located("???") == error


def fold(texts):
    united = simplify_type(parse_type(texts[0]))
    for text in texts[1:]:
        united = union_types(united, simplify_type(parse_type(text)))
    return united


@pytest.mark.parametrize("texts, printed", UNITED)
def test_union(texts, printed):
    assert type_text(fold(texts)) == printed


@pytest.mark.parametrize("text, printed", SIMPLIFIED)
def test_simplify(text, printed):
    assert type_text(simplify_type(parse_type(text))) == printed


def test_union_of_one_member_is_kept_apart_from_it():
    alone = union_types("any", parse_type("Array<null> | boolean"))
    assert alone == ("union", ("any",))
    assert type_json(alone) == '"any"'
    # Taken into another union it changes the first member and keeps the rest.
    assert type_text(union_types(alone, parse_type("number | null"))) == "any | null"


def random_type(rng, depth=3):
    kind = rng.randrange(7) if depth else rng.randrange(2)
    if kind < 2:
        return rng.choice(["number", "string", "null", "undefined", "boolean"])
    if kind == 2:
        return f"Array<{random_type(rng, depth - 1)}>"
    if kind == 3:
        return f"Map<string, {random_type(rng, depth - 1)}>"
    if kind == 4:
        return " | ".join(random_type(rng, depth - 1) for _ in range(2))
    names = sorted(rng.sample("abcde", rng.randrange(4)))
    return "{" + "; ".join(f"{n}: {random_type(rng, depth - 1)}" for n in names) + "}"


def test_states_and_texts_survive_a_round_trip():
    rng = random.Random(7)
    for _ in range(300):
        t = simplify_type(parse_type(random_type(rng)))
        assert read_state(type_state(t)) == t
        assert type_text(parse_type(type_text(t))) == type_text(t)
