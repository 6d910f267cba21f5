"""The queries in SQL for DuckDB, on the same tables."""

from workloads import tables

_MODULES = "JSIPCValSend|JSIPCValRecv|JSIPCTypeSend|JSIPCTypeRecv|JSIPCTypeChecking|JSIPCTypeMemory|JSIPCSerializer"
_TYPE_LINE = "^JSIT (Send|Recv) ACTOR ([^ ]+) MESSAGE ([^ ]+) KIND (Message|Query|QueryResolve|QueryReject) TYPE (.+)$"


def _part(n):
    return f"regexp_extract(msg, '{_TYPE_LINE}', {n})"


def _events(source):
    """CTEs from lines to the uses that are left after all filters."""
    return f"""
    lines AS ({source}),
    records AS (
      SELECT line_no, regexp_extract(line, '/({_MODULES}) (.*)$', 1) AS module,
             regexp_extract(line, '/({_MODULES}) (.*)$', 2) AS msg
      FROM lines WHERE regexp_matches(line, '/({_MODULES}) (.*)$')),
    sent AS (SELECT * FROM records WHERE module = 'JSIPCTypeSend'),
    sent_types AS (
      SELECT line_no, {_part(1)} AS direction, {_part(2)} AS actor, {_part(3)} AS message,
        CASE {_part(4)} WHEN 'Message' THEN 0 WHEN 'Query' THEN 1 WHEN 'QueryResolve' THEN 2
                        ELSE 3 END AS kind,
        {_part(5)} AS raw_type
      FROM sent WHERE regexp_matches(msg, '{_TYPE_LINE}')),
    good AS (
      SELECT * FROM sent_types WHERE raw_type NOT IN ('NO VALUE', 'FAILED')
        AND NOT (actor = 'Conduits' AND message = 'CreateProxyContext' AND kind = 1)),
    uses AS (
      SELECT raw_type, actor, message, kind, min(line_no) AS first_line, count(*) AS events
      FROM good GROUP BY ALL)"""


_EVENTS = f"WITH {_events(tables.LOG_LINES)}"


def _log(select):
    return f"{_EVENTS} {select}"


_COLUMNS = "line_no, actor, message, kind, raw_type"

# What the seven event types print as once simplified.
_EVENT_TEXT = """
    SELECT * FROM (VALUES
      ('{k: number}', '{k: number}'),
      ('{k: number; v?: number}', '{k: number; v?: number}'),
      ('{k: number; v: string}', '{k: number; v: string}'),
      ('{a: number; b: string; c: null}', '{a: number; b: string; c: null}'),
      ('Array<number> | Array<string>', 'Array<number | string>'),
      ('undefined', 'undefined'),
      ('{k: string} | {k: number; tags: Array<string>}', '{k: number | string; tags?: Array<string>}')
    ) v(raw_type, type_ts)"""
# The union of all seven in the order they appear, worked out by hand.
_EVENT_UNION = (
    "Array<number | string> | undefined | {a: number; b: string; c: null} | "
    "{k: number | string; tags?: Array<string>} | {k: number; v?: number | string}"
)

_ORDER_RAW = f"typed AS ({tables.ORDER_TYPES})"


def _order_json(simplified):
    c_two = '["array", ["union", "number", "string"]]' if simplified else (
        '["union", ["array", "number"], ["array", "string"]]'
    )
    g_two = '["object", ["k", "string"], ["l", "number", true]]' if simplified else (
        '["union", ["object", ["k", "string"]], ["object", ["k", "string"], ["l", "number"]]]'
    )
    return f"""'["object", ["a", "' || a || '"], ["b", '
      || CASE WHEN b_two THEN '["union", "string", "number"]' ELSE '"number"' END || '], ["c", '
      || CASE WHEN c_two THEN '{c_two}' ELSE '["array", "' || c_one || '"]' END
      || '], ["d", "number"], ["e", ["object", ["x", "' || x || '"], ["y", "null"]'
      || CASE WHEN has_z THEN ', ["z", "number", true]' ELSE '' END || ']], ["f", "string"], ["g", '
      || CASE WHEN g_two THEN '{g_two}' ELSE '["object", ["k", "string"]]' END || ']'
      || CASE WHEN has_p THEN ', ["p", "number"]' ELSE '' END
      || CASE WHEN has_q THEN ', ["q", "string", true]' ELSE '' END
      || CASE WHEN has_r THEN ', ["r", ["set", "number"]]' ELSE '' END
      || CASE WHEN has_s THEN ', ["s", ["map", "string", "any"]]' ELSE '' END
      || CASE WHEN has_t THEN ', ["t", "testOnly"]' ELSE '' END
      || CASE WHEN has_12 THEN ', [12, "null"]' ELSE '' END || ']'"""


def _order_text(simplified):
    c_two = "Array<number | string>" if simplified else "Array<number> | Array<string>"
    g_two = "{k: string; l?: number}" if simplified else "{k: string; l: number} | {k: string}"
    text = tables.ORDER_TYPES[tables.ORDER_TYPES.index("'{a: '"):]
    text = text[: text.index("AS raw_type")]
    return (
        text.replace("'string | number'", "'number | string'")
        .replace("'Array<number> | Array<string>'", f"'{c_two}'")
        .replace("'{k: string} | {k: string; l: number}'", f"'{g_two}'")
    )


def _types_of(condition):
    return f"CASE WHEN count(*) FILTER ({condition}) = count(*) THEN '' ELSE '?' END"


def _sometimes(flag, name, text, stated=False):
    mark = "'?'" if stated else _types_of(flag)
    return f"CASE WHEN bool_or({flag}) THEN '; {name}' || {mark} || ': {text}' ELSE '' END"


_ORDER_UNION = f"""
    united AS (
      SELECT actor, message, kind,
        '{{a: ' || string_agg(DISTINCT a, ' | ' ORDER BY a)
        || '; b: ' || CASE WHEN bool_or(b_two) THEN 'number | string' ELSE 'number' END
        || '; c: Array<' || CASE WHEN bool_or(c_two) OR count(DISTINCT c_one) = 2
                                 THEN 'number | string' ELSE min(c_one) END
        || '>; d: number; e: {{x: ' || string_agg(DISTINCT x, ' | ' ORDER BY x) || '; y: null'
        || CASE WHEN bool_or(has_z) THEN '; z?: number' ELSE '' END
        || '}}; f: string; g: {{k: string' || CASE WHEN bool_or(g_two) THEN '; l?: number' ELSE '' END
        || '}}'
        || {_sometimes('has_p', 'p', 'number')}
        || {_sometimes('has_q', 'q', 'string', stated=True)}
        || {_sometimes('has_r', 'r', 'Set<number>')}
        || {_sometimes('has_s', 's', 'Map<string, any>')}
        || {_sometimes('has_t', 't', 'testOnly')}
        || {_sometimes('has_12', '12', 'null')} || '}}' AS type_ts,
        count(DISTINCT raw_type) AS n_types
      FROM typed GROUP BY actor, message, kind)"""
_ORDER_CATALOG = f"""
    WITH {_ORDER_RAW}, {_ORDER_UNION},
    catalog AS (
      SELECT actor, message, CASE WHEN min(kind) = 0 THEN 1 ELSE 2 END AS arity,
        max(CASE WHEN kind IN (0, 1) THEN type_ts END) AS slot0,
        max(CASE WHEN kind = 2 THEN type_ts END) AS slot1
      FROM united GROUP BY actor, message)"""

_OVERRIDDEN = f"""{_ORDER_CATALOG}
    SELECT actor, message, arity,
      CASE WHEN actor = 'OrderF' AND message = 'P:1' THEN 'any' ELSE slot0 END AS slot0,
      CASE WHEN actor = 'OrderF' AND message = 'P:5' THEN 'any' ELSE slot1 END AS slot1,
      CASE WHEN actor = 'OrderF' AND message = 'P:1' THEN 'c1'
           WHEN actor = 'OrderF' AND message = 'P:5' THEN 'c2' ELSE '' END AS comment
    FROM catalog WHERE actor <> 'OrderO'
    UNION ALL SELECT 'OrderO', NULL, 1, 'testOnly', NULL, ''
    UNION ALL SELECT 'newActor', 'X', 1, 'undefined', NULL, 'c3'"""

_CUSTOMERS = f"""
    WITH typed AS ({tables.CUSTOMER_TYPES}),
    kinds AS (
      SELECT actor, message, min(raw_type) AS raw_type, min(json) AS json,
        bool_or(kind_word = 'Message') AS m, bool_or(kind_word = 'Query') AS q,
        bool_or(kind_word = 'QueryResolve') AS r, bool_or(kind_word = 'QueryReject') AS j
      FROM typed GROUP BY actor, message),
    unified AS (
      SELECT actor, message, CASE WHEN m THEN 1 ELSE 2 END AS arity,
        CASE WHEN m OR q THEN raw_type END AS slot0,
        CASE WHEN m THEN NULL WHEN j AND NOT r THEN 'never' WHEN r THEN raw_type END AS slot1,
        CASE WHEN m OR q THEN json END AS json0,
        CASE WHEN m THEN NULL WHEN j AND NOT r THEN '"never"' WHEN r THEN json END AS json1,
        CASE WHEN m AND (q OR r OR j)
             THEN 'Message ' || message || ' of actor ' || actor || ' has both message and query types.'
             WHEN j AND NOT r AND actor NOT IN ('TestWindow', 'TestProcessActor')
             THEN 'Message ' || message || ' of actor ' || actor
               || ' has a query reject type but not a query resolve type, which we can''t really represent.'
        END AS error
      FROM kinds),
    checked AS (
      SELECT * REPLACE (CASE WHEN actor LIKE 'bad-%'
        THEN 'Actor name "' || actor || '" should be a valid identifier' ELSE error END AS error)
      FROM unified),
    catalog AS (SELECT * FROM checked WHERE error IS NULL),
    ends AS (
      SELECT *, message = max(message) OVER (PARTITION BY actor) AS last_message,
             actor = max(actor) OVER () AS last_actor
      FROM catalog)"""
_SLOT_TS = """CASE WHEN arity = 1 THEN slot0
  ELSE '(_: ' || coalesce(slot0, 'never') || ') => ' || coalesce(slot1, 'never') END"""


def _document(head, opening, line, closing, foot):
    parts = []
    if head:
        parts.append(f"SELECT 0 AS section, '' AS actor, 0 AS step, '' AS message, '{head}' AS line")
    parts.append(f"SELECT DISTINCT 1 AS section, actor, 0 AS step, '' AS message, {opening} AS line FROM ends")
    parts.append(f"SELECT 1, actor, 1, message, {line} FROM ends")
    parts.append(f"SELECT DISTINCT 1, actor, 2, '', {closing} FROM ends")
    if foot:
        parts.append(f"SELECT 2, '', 0, '', '{foot}'")
    return _CUSTOMERS + " " + " UNION ALL ".join(parts)


_DECLARED = f"""
    WITH files AS (
      SELECT *, CAST(regexp_extract(file, '[0-9]+') AS BIGINT) AS n,
        regexp_extract(text, '''N:([0-9]+)''', 1) AS nation
      FROM ({tables.DECLARED_FILES}) f),
    errors AS (
      SELECT *, CASE
          WHEN n % 11 = 5 THEN file || ':4: Syntax error near ">"'
          WHEN n % 7 = 3 THEN file || ':2: Actor name "3A" should be a valid identifier'
        END AS error,
        'Sup' || CAST(CAST(floor(n / 2) AS BIGINT) AS VARCHAR) AS actor
      FROM files),
    good AS (SELECT * FROM errors WHERE error IS NULL),
    declared AS (
      SELECT file, n, actor, 'M' AS message, 2 AS actor_line, 3 AS line, 1 AS arity,
             'null | number' AS slot0, NULL AS slot1, '["union", "number", "null"]' AS slot0_json,
             NULL AS slot1_json
      FROM good
      UNION ALL
      SELECT file, n, actor, 'N:' || nation, 2, 4, 2, 'string', '{{k?: number}}', '"string"',
             '["object", ["k", "number", true]]' FROM good
      UNION ALL
      SELECT file, n, actor, 'M', 2, 5, 2, NULL, 'any', NULL, '"any"' FROM good WHERE n % 13 = 6
      UNION ALL
      SELECT file, n, 'W' || CAST(n AS VARCHAR), NULL, CASE WHEN n % 13 = 6 THEN 7 ELSE 6 END,
             NULL, 1, 'testOnly', NULL, '"testOnly"', NULL FROM good)""".replace("{{", "{").replace("}}", "}")

_VALUES = f"""
    WITH found AS (
      SELECT line_no, actor, message, k, contents FROM ({tables.VALUE_PARTS}) parts),
    kept AS (SELECT * FROM found WHERE actor <> 'DevToolsFrame'),
    typed AS (
      SELECT *, CASE WHEN message = 'order' THEN
          '{{"id": number' || CASE k % 3 WHEN 0 THEN ', "note": string' WHEN 1 THEN ', "note": null' ELSE '' END
          || ', "tags": Array(' || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'number' WHEN 2 THEN 'number, string'
                                              ELSE 'ObjMap(string, bool)' END || ')}}'
        WHEN k % 97 <> 0
        THEN '{{id: number, when: Date, re: regexp, "q": Array(bool, null, number, undefined)}}'
        END AS type_text
      FROM kept),
    strict AS (
      SELECT actor, message, type_text, min(line_no) AS first_line, count(*) AS events
      FROM typed WHERE type_text IS NOT NULL GROUP BY ALL),
    united AS (
      SELECT actor, 'order' AS message,
        CASE WHEN first_k % 3 = 2
             THEN '{{"id": number, "tags": Array(' || tags || '), "note"?: null | string}}'
             ELSE '{{"id": number, "note"?: null | string, "tags": Array(' || tags || ')}}' END AS type_text
      FROM (
        SELECT actor, arg_min(k, line_no) AS first_k, 'number, string, ObjMap(string, bool)' AS tags
        FROM kept WHERE message = 'order' GROUP BY actor)
      UNION ALL
      SELECT DISTINCT actor, message, type_text FROM typed
      WHERE message = 'lit' AND type_text IS NOT NULL)""".replace("{{", "{").replace("}}", "}")

_FILES = f"""
    WITH lines AS ({tables.EVENT_LINES}),
    failures AS (
      SELECT DISTINCT regexp_extract(line, 'Type checking failed: (.*)$', 1) AS failure,
        'runs/log-' || CAST(line_no % 10 AS VARCHAR) || '.txt' AS file_path
      FROM lines WHERE line LIKE '%Type checking failed: %')"""

# Places of the order types: path, parent, tag, name, stated optional, pos, condition.
_PLACES = [
    ("$", None, "'object'", None, "false", 0, "true"),
    ("$.a", "$", "a", "a", "false", 0, "true"),
    ("$.b", "$", "CASE WHEN b_two THEN 'string' ELSE 'number' END", "b", "false", 0, "true"),
    ("$.b", "$", "'number'", "b", "false", 1, "b_two"),
    ("$.c", "$", "'array'", "c", "false", 0, "true"),
    ("$.c", "$", "'array'", "c", "false", 1, "c_two"),
    ("$.c[]", "$.c", "CASE WHEN c_two THEN 'number' ELSE c_one END", None, "false", 0, "true"),
    ("$.c[]", "$.c", "'string'", None, "false", 0, "c_two"),
    ("$.d", "$", "'number'", "d", "false", 0, "true"),
    ("$.e", "$", "'object'", "e", "false", 0, "true"),
    ("$.e.x", "$.e", "x", "x", "false", 0, "true"),
    ("$.e.y", "$.e", "'null'", "y", "false", 0, "true"),
    ("$.e.z", "$.e", "'number'", "z", "true", 0, "has_z"),
    ("$.f", "$", "'string'", "f", "false", 0, "true"),
    ("$.g", "$", "'object'", "g", "false", 0, "true"),
    ("$.g", "$", "'object'", "g", "false", 1, "g_two"),
    ("$.g.k", "$.g", "'string'", "k", "false", 0, "true"),
    ("$.g.k", "$.g", "'string'", "k", "false", 0, "g_two"),
    ("$.g.l", "$.g", "'number'", "l", "false", 0, "g_two"),
    ("$.p", "$", "'number'", "p", "false", 0, "has_p"),
    ("$.q", "$", "'string'", "q", "true", 0, "has_q"),
    ("$.r", "$", "'set'", "r", "false", 0, "has_r"),
    ("$.r<>", "$.r", "'number'", None, "false", 0, "has_r"),
    ("$.s", "$", "'map'", "s", "false", 0, "has_s"),
    ("$.s{k}", "$.s", "'string'", None, "false", 0, "has_s"),
    ("$.s{v}", "$.s", "'any'", None, "false", 0, "has_s"),
    ("$.t", "$", "'testOnly'", "t", "false", 0, "has_t"),
    ("$.12", "$", "'null'", "12", "false", 0, "has_12"),
]


def _text(value):
    return "NULL" if value is None else f"'{value}'"


_NODES = " UNION ALL ".join(
    f"SELECT *, '{path}' AS path, {_text(parent)} AS parent_path, {tag} AS tag, {_text(name)} AS name, "
    f"{optional} AS optional, {pos} AS pos FROM shapes WHERE {condition}"
    for path, parent, tag, name, optional, pos, condition in _PLACES
)
_ORDER_NODES = f"""
    WITH {_ORDER_RAW},
    shapes AS (
      SELECT DISTINCT * EXCLUDE (k, c, actor, message, kind)
        REPLACE (CASE WHEN c_two THEN 'number' ELSE c_one END AS c_one) FROM typed),
    nodes AS ({_NODES})"""

# Shapes that overlap: two that share more than half of the larger one's names join.
_ABC, _BCD, _CDE, _ABCD, _BCDE = (
    [(n, n in optional) for n in names]
    for names, optional in (("abc", ""), ("bcd", ""), ("cde", ""), ("abcd", "ad"), ("bcde", "be"))
)


def _shape_text(shape):
    return "{" + "; ".join(f"{n}{'?' * o}: number" for n, o in shape) + "}"


def _shape_json(shape):
    return '["object", ' + ", ".join(f'["{n}", "number"{", true" * o}]' for n, o in shape) + "]"


def _in_order(shown, joined):
    """What the fold gives, by the statuses in order of their first orders."""
    both = {
        "F": [_ABC], "O": [_BCD], "P": [_CDE], "FO": [_ABCD], "OF": [_ABCD], "OP": [_BCDE], "PO": [_BCDE],
        "FP": [_ABC, _CDE], "PF": [_CDE, _ABC], "FOP": [_ABCD, _CDE], "OFP": [_ABCD, _CDE],
        "OPF": [_BCDE, _ABC], "POF": [_BCDE, _ABC], "FPO": [_CDE, _ABCD], "PFO": [_ABC, _BCDE],
    }
    cases = "".join(f" WHEN '{order}' THEN '{joined(list(map(shown, shapes)))}'" for order, shapes in both.items())
    return f"CASE statuses{cases} END"


_UNION_IN_ORDER = f"""
    WITH firsts AS (
      SELECT o_custkey, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY o_custkey, o_orderstatus),
    ordered AS (
      SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY k) AS statuses, count(*) AS n_types
      FROM firsts GROUP BY o_custkey)
    SELECT 'c' || CAST(o_custkey AS VARCHAR) AS actor, n_types,
      {_in_order(_shape_json, lambda t: t[0] if len(t) == 1 else '["union", ' + ", ".join(t) + "]")} AS type_json,
      {_in_order(_shape_text, lambda t: " | ".join(sorted(t)))} AS type_ts
    FROM ordered"""


def _deep_text():
    """From the innermost level outwards: an array if any type goes deeper, an object if one ends here."""
    text = "'{v: number}'"
    for depth in range(7, 4, -1):
        text = f"""CASE WHEN deepest > {depth} THEN 'Array<' || {text} || '>' ELSE '' END
          || CASE WHEN deepest > {depth} AND list_contains(depths, {depth}) THEN ' | ' ELSE '' END
          || CASE WHEN list_contains(depths, {depth}) THEN '{{v: number}}' ELSE '' END"""
    return f"repeat('Array<', 5) || {text} || repeat('>', 5)"


_DEEP = f"""
    WITH found AS (
      SELECT l_suppkey, list(DISTINCT l_linenumber % 4 + 5) AS depths, max(l_linenumber % 4 + 5) AS deepest
      FROM lineitem GROUP BY l_suppkey)
    SELECT 'm' || CAST(l_suppkey AS VARCHAR) AS actor, {_deep_text()} AS type_ts FROM found"""

ORACLES = {
    "t3_union_in_order": _UNION_IN_ORDER,
    "t13_merged_deep_types": _DEEP,
    "s1_read_logs": f"SELECT line, count(*) AS n FROM ({tables.EVENT_LINES}) l GROUP BY line",
    "s2_stream_logs": f"WITH {_events(tables.EVENT_LINES)} "
    "SELECT module, msg, count(*) AS n FROM records GROUP BY ALL",
    "s3_read_declarations": f"SELECT file_rank, text FROM ({tables.DECLARED_FILES}) f",
    "s4_read_overrides": "SELECT 'Part' || CAST(p_partkey AS VARCHAR) AS actor, p_name AS message, "
    "1 AS arity, 'any' AS slot0, CAST(NULL AS VARCHAR) AS slot1, "
    "CASE WHEN p_size > 25 THEN p_type ELSE '' END AS comment FROM part",
    "e1_extract_records": _log("SELECT line_no, module, msg FROM records"),
    "e2_extract_type_events": _log(f"SELECT {_COLUMNS}, direction FROM sent_types"),
    "e3_malformed_events": _log(
        "SELECT line_no, 'Unknown JSIPCTypeSend: ' || msg AS error FROM sent "
        f"WHERE NOT regexp_matches(msg, '{_TYPE_LINE}')"
    ),
    "e4_kind_code": _log("SELECT kind, count(*) AS events FROM sent_types GROUP BY kind"),
    "e5_drop_no_value": _log(f"SELECT {_COLUMNS} FROM sent_types WHERE raw_type <> 'NO VALUE'"),
    "e6_failed_types": _log("SELECT line_no, actor, message FROM sent_types WHERE raw_type = 'FAILED'"),
    "e7_ignore_actors": _log(f"SELECT {_COLUMNS} FROM sent_types WHERE actor NOT IN ('click', 'no such')"),
    "e7_ignored_actors_seen": _log(
        "SELECT DISTINCT actor FROM sent_types WHERE actor IN ('click', 'view', 'no such')"
    ),
    "e8_exclude_rules": _log(
        f"SELECT {_COLUMNS} FROM sent_types WHERE NOT (actor = 'click' AND message = 'M:3' AND kind = 2) "
        "AND NOT (actor = 'view' AND message = 'M:0')"
    ),
    "e9_fallback_events": _log(
        "SELECT line_no, regexp_extract(msg, '^UntypedFromJSVal fallback: (.+)$', 1) AS fallback "
        "FROM records WHERE module = 'JSIPCSerializer' AND msg LIKE 'UntypedFromJSVal fallback: _%'"
    ),
    "e10_serializer_events": _log(
        "SELECT line_no, msg FROM records WHERE module = 'JSIPCSerializer' "
        "AND msg NOT LIKE 'UntypedFromJSVal fallback: _%'"
    ),
    "e11_other_records": _log(
        "SELECT line_no, module || ': ' || msg AS text FROM records "
        "WHERE module NOT IN ('JSIPCTypeSend', 'JSIPCSerializer')"
    ),
    "e12_extract_value_events": f"{_VALUES} SELECT line_no, actor, message, contents FROM found",
    "e13_exclude_value_rules": f"{_VALUES} SELECT line_no, actor, message, contents FROM kept",
    "e14_extract_check_failures": _log(
        "SELECT line_no, regexp_extract(line, 'Type checking failed: (.*)$', 1) AS failure "
        "FROM lines WHERE line LIKE '%Type checking failed: %'"
    ),
    "a1_distinct_type_uses": _log("SELECT * FROM uses"),
    "a1_distinct_order_uses": f"WITH {_events(tables.ORDER_LINES)} SELECT * FROM uses",
    "a2_group_types": _log(
        f", texts AS ({_EVENT_TEXT}), firsts AS (SELECT raw_type, min(first_line) AS raw_first_line "
        "FROM uses GROUP BY raw_type) SELECT actor, message, kind, type_ts, raw_first_line "
        "FROM uses JOIN texts USING (raw_type) JOIN firsts USING (raw_type)"
    ),
    "a3_fallback_counts": _log(
        "SELECT substr(msg, 28) AS fallback, count(*) AS events FROM records "
        "WHERE module = 'JSIPCSerializer' AND msg LIKE 'UntypedFromJSVal fallback: _%' GROUP BY ALL"
    ),
    "a4_serializer_counts": _log(
        "SELECT msg, count(*) AS events FROM records WHERE module = 'JSIPCSerializer' "
        "AND msg NOT LIKE 'UntypedFromJSVal fallback: _%' GROUP BY ALL"
    ),
    "a5_other_messages": _log(
        "SELECT DISTINCT module || ': ' || msg AS text FROM records "
        "WHERE module NOT IN ('JSIPCTypeSend', 'JSIPCSerializer')"
    ),
    "a6_failure_files": f"{_FILES} SELECT failure, file_path FROM failures",
    "a7_strip_common_prefix": f"{_FILES} SELECT DISTINCT CAST(line_no % 10 AS VARCHAR) || '.txt' AS file_path FROM lines",
    "a8_name_chars": f"""
        WITH names AS (
          SELECT actor, message FROM ({_ORDER_CATALOG} SELECT actor, message FROM catalog) o
          UNION ALL SELECT actor, message FROM ({_CUSTOMERS} SELECT actor, message FROM catalog) c),
        chars AS (
          SELECT 'actor' AS part, unnest(string_split(actor, '')) AS c FROM names
          UNION ALL SELECT 'message', unnest(string_split(message, '')) FROM names),
        odd AS (SELECT DISTINCT part, c FROM chars WHERE NOT regexp_matches(c, '^[a-zA-Z0-9]$'))
        SELECT coalesce(string_agg(CASE WHEN part = 'actor' THEN c END, '' ORDER BY c), 'none') AS actor_chars,
               coalesce(string_agg(CASE WHEN part = 'message' THEN c END, '' ORDER BY c), 'none') AS message_chars
        FROM odd""",
    "t1_parse_types": f"WITH {_ORDER_RAW} SELECT DISTINCT raw_type, {_order_json(False)} AS type_json, "
    f"{_order_text(False)} AS type_ts FROM typed",
    "t2_simplify_types": f"WITH {_ORDER_RAW} SELECT DISTINCT raw_type, {_order_json(True)} AS type_json, "
    f"{_order_text(True)} AS type_ts FROM typed",
    "t3_union_types": f"WITH {_ORDER_RAW}, {_ORDER_UNION} SELECT * FROM united",
    "t3_union_event_types": _log(
        f"SELECT actor, message, kind, '{_EVENT_UNION}' AS type_ts, count(*) AS n_types "
        "FROM uses GROUP BY actor, message, kind"
    ),
    "t4_mergeable_shapes": """
        WITH shaped AS (
          SELECT event_id AS k, event_type AS actor,
            list_distinct(['n' || CAST(event_id % 3 AS VARCHAR), 'n' || CAST(event_id % 5 AS VARCHAR),
                           'n' || CAST(user_id % 7 AS VARCHAR), 'n' || CAST(user_id % 4 AS VARCHAR)]) AS names
          FROM events),
        firsts AS (SELECT actor, arg_min(names, k) AS names_b FROM shaped GROUP BY actor),
        pairs AS (
          SELECT k, actor, len(list_intersect(names, names_b)) AS shared, len(names) AS a, len(names_b) AS b
          FROM shaped JOIN firsts USING (actor))
        SELECT k, actor, shared = least(a, b) OR 2 * shared > greatest(a, b) AS mergeable FROM pairs""",
    "t4_mergeable_pairs": """
        WITH shaped AS (
          SELECT DISTINCT event_type AS actor,
            list_sort(list_distinct(['n' || CAST(event_id % 3 AS VARCHAR), 'n' || CAST(event_id % 5 AS VARCHAR),
                           'n' || CAST(user_id % 7 AS VARCHAR), 'n' || CAST(user_id % 4 AS VARCHAR)])) AS names
          FROM events),
        pairs AS (
          SELECT a.actor, a.names AS a, b.names AS b, len(list_intersect(a.names, b.names)) AS shared
          FROM shaped a JOIN shaped b ON a.actor = b.actor AND a.names <> b.names
            AND (len(a.names), array_to_string(a.names, ' ')) < (len(b.names), array_to_string(b.names, ' ')))
        SELECT actor, array_to_string(a, ' ') AS names_a, array_to_string(b, ' ') AS names_b
        FROM pairs WHERE shared = len(a) OR 2 * shared > len(b)""",
    "t11_combine_log": _log(
        f", texts AS ({_EVENT_TEXT}) SELECT actor, message, kind, type_ts AS input_ts, "
        f"count(*) OVER (PARTITION BY actor, message, kind) AS n_types, '{_EVENT_UNION}' AS combined_ts, "
        "CASE kind WHEN 0 THEN 'sendAsyncMessage()' WHEN 1 THEN 'sendQuery()' WHEN 2 THEN 'query reply' "
        "ELSE 'query reject' END AS kind_label FROM uses JOIN texts USING (raw_type)"
    ),
    "t12_type_nodes": f"{_ORDER_NODES} SELECT raw_type, path, parent_path, tag, name, optional, pos FROM nodes",
    "t13_merge_nodes": f"""{_ORDER_NODES},
        uses AS (SELECT DISTINCT actor, message, kind, raw_type FROM typed),
        keyed AS (SELECT u.actor, u.message, u.kind, n.* FROM uses u JOIN nodes n USING (raw_type)),
        places AS (
          SELECT actor, message, kind, path, parent_path, name,
            string_agg(DISTINCT tag, ' | ' ORDER BY tag) AS tags, bool_or(optional) AS stated,
            count(*) FILTER (pos = 0) AS present, count(*) FILTER (tag = 'object') AS objects
          FROM keyed GROUP BY ALL)
        SELECT p.actor, p.message, p.kind, p.path, p.name, p.tags,
          p.stated OR (p.name IS NOT NULL AND p.present < coalesce(q.objects, 0)) AS optional, p.present
        FROM places p LEFT JOIN places q
          ON p.actor = q.actor AND p.message = q.message AND p.kind = q.kind AND p.parent_path = q.path""",
    "t13_merged_types": f"WITH {_ORDER_RAW}, {_ORDER_UNION} SELECT actor, message, kind, type_ts FROM united",
    "c1_unify_kinds": f"{_CUSTOMERS} SELECT actor, message, arity, slot0, slot1, error FROM unified",
    "c2_validate_messages": f"{_CUSTOMERS} SELECT actor, message, error FROM checked WHERE error IS NOT NULL",
    "c3_build_catalog": f"{_ORDER_CATALOG} SELECT * FROM catalog",
    "c4_apply_overrides": _OVERRIDDEN,
    "c4_apply_accepted_overrides": f"""{_CUSTOMERS}
        SELECT actor, message, arity, slot0, slot1, '' AS comment
        FROM catalog WHERE NOT (actor = 'C0' AND message = 'E:FURNITURE')
        UNION ALL SELECT 'C0', 'E:FURNITURE', 1, 'any', NULL, 'good'""",
    "c5_validate_overrides": f"""{_CUSTOMERS}
        SELECT actor, message, 'type [' || json0 || '] and override ["any", "never"] must have the same length' AS error
        FROM catalog WHERE actor = 'C0' AND message = 'E:AUTOMOBILE'
        UNION ALL SELECT actor, message, 'override type ["any"] must have a comment'
        FROM catalog WHERE actor = 'C0' AND message = 'E:BUILDING'
        UNION ALL SELECT actor, message, 'Expected a type in query override'
        FROM catalog WHERE actor = 'C4' AND message = 'E:AUTOMOBILE'
        UNION ALL SELECT * FROM (VALUES
          ('C5', NULL, 'Non-testOnly single actor override types need a comment'),
          ('B-2', 'M', 'Actor name "B-2" should be a valid identifier'),
          ('C0', '3 x', 'Message name "3 x" should be a valid identifier (it can also contain "-" or ":" after the first character)'),
          ('C10', 'E:BUILDING', 'Multiple declarations of message E:BUILDING for actor C10.'),
          ('C15', NULL, 'Multiple declarations of actor C15.'),
          ('C15', 'E:BUILDING', 'Multiple declarations of actor C15.'))""",
    "c6_parse_declarations": f"""{_DECLARED}
        SELECT file, actor, message, actor_line, line, arity, slot0, slot1, CAST(NULL AS VARCHAR) AS error
        FROM declared
        UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM errors
        WHERE error IS NOT NULL""",
    "c7_merge_catalogs": f"""{_DECLARED},
        firsts AS (SELECT actor, min(n) AS first_n FROM good GROUP BY actor)
        SELECT file, error FROM errors WHERE error IS NOT NULL
        UNION ALL
        SELECT file, file || ':2: Multiple declarations of actor ' || actor || '. Previous was at decl/'
          || CAST(first_n AS VARCHAR) || '.ts:2' FROM good JOIN firsts USING (actor) WHERE n > first_n
        UNION ALL
        SELECT file, file || ':5: Multiple declarations of message M for actor ' || actor
          || '. Previous was at ' || file || ':3' FROM good WHERE n % 13 = 6""",
    "c8_write_catalog_json": _document(
        "{",
        """'  "' || actor || '": {'""",
        """'    "' || message || '": [' || CASE WHEN arity = 1 THEN json0
             ELSE coalesce(json0, '"never"') || ', ' || coalesce(json1, '"never"') END || ']'
             || CASE WHEN last_message THEN '' ELSE ',' END""",
        "'  }' || CASE WHEN last_actor THEN '' ELSE ',' END",
        "}",
    ),
    "c9_write_catalog_ts": _document(
        "type MessageTypes = {",
        "'  ' || actor || ': {'",
        f"""'    "' || message || '": ' || {_SLOT_TS} || ';'""",
        "'  };'",
        "};",
    ),
    "c10_write_catalog_text": _document(
        None, "actor", f"'  ' || message || ' : ' || {_SLOT_TS}", "''", None
    ),
    "c11_translate_declarations": f"{_DECLARED} SELECT actor, message, arity, slot0_json, slot1_json FROM declared",
    "c12_discover": _log(
        "SELECT actor, message, CASE WHEN min(kind) = 0 THEN 1 ELSE 2 END AS arity, "
        f"max(CASE WHEN kind IN (0, 1) THEN '{_EVENT_UNION}' END) AS slot0, "
        f"max(CASE WHEN kind = 2 THEN '{_EVENT_UNION}' END) AS slot1 FROM uses GROUP BY actor, message"
    ),
    "c12_discover_orders": _OVERRIDDEN,
    "c13_find_failures": f"{_FILES} SELECT failure, replace(file_path, 'runs/log-', '') AS file_path FROM failures",
    "v1_parse_payloads": f"""{_VALUES}
        SELECT line_no,
          CASE WHEN message = 'order' THEN contents
               WHEN k % 97 <> 0 THEN '{{"id": ' || CAST(k AS VARCHAR)
                 || ', "when": {{"$type": "Date", "text": "Date"}}, "re": {{"$type": "regexp", "text": "'
                 || regexp_extract(contents, '/(a[0-9]+)/', 1)
                 || '"}}, "q": [true, null, {{"$type": "number", "text": "Infinity"}}, '
                 || '{{"$type": "undefined", "text": "undefined"}}]}}' END AS value,
          CASE WHEN message = 'lit' AND k % 97 = 0 THEN 'Unknown constructor Foo' END AS error
        FROM kept""".replace("{{", "{").replace("}}", "}"),
    "v2_infer_value_types": f"{_VALUES} SELECT actor, message, type_text, count(*) AS events FROM typed GROUP BY ALL",
    "v2_keyed_value_types": f"""
        SELECT 'Keyed' || status AS actor, 'm' || CAST(k % 5 AS VARCHAR) AS message,
          CASE k % 5 WHEN 0 THEN 'ObjMap(string, {{"total": number, "open": bool}})' WHEN 1 THEN 'ObjMap(number, Array(string))'
            WHEN 2 THEN 'ObjMap(string, ObjMap(string, number))'
            WHEN 3 THEN '{{"' || a || '": number, "' || b || '": string}}' END AS type_text,
          count(*) AS events, CASE WHEN max(k % 5) < 3 THEN 1 ELSE count(*) END AS payloads
        FROM ({tables.KEYED_VALUES}) lines GROUP BY ALL""",
    "v3_detect_map_objects": f"""{_VALUES},
        types AS (
          SELECT DISTINCT actor, message, k % 3 AS note, k % 4 AS tags FROM kept WHERE message = 'order'
          UNION ALL SELECT DISTINCT actor, message, 0, 0 FROM kept WHERE message = 'lit' AND k % 97 <> 0)
        SELECT actor, message, '$' AS path, false AS is_map, CAST(NULL AS VARCHAR) AS key_type,
               CAST(NULL AS VARCHAR) AS value_type, count(*) AS types FROM types GROUP BY actor, message
        UNION ALL
        SELECT actor, message, '$."\\"tags\\""[]', true, 'string', 'bool', count(*) FROM types WHERE tags = 3
        GROUP BY actor, message""",
    "v3_detect_map_props": "SELECT DISTINCT event_type AS actor, '$' AS path, true AS is_map, "
    "'string' AS key_type, 'number' AS value_type FROM events "
    "WHERE len(json_keys(props)) > 0",
    "v4_distinct_value_types": f"{_VALUES} SELECT * FROM strict",
    "v5_union_value_types": f"{_VALUES} SELECT actor, message, type_text, 1 AS n_types FROM united",
    "v7_value_type_report": f"""{_VALUES},
        seen AS (SELECT actor, message, min(first_line) AS message_line FROM strict GROUP BY ALL)
        SELECT actor, message, CAST(1 AS BIGINT) AS n_types, type_text, min(message_line) OVER (PARTITION BY actor) AS actor_line,
               message_line
        FROM united JOIN seen USING (actor, message)""",
    "v13_merge_value_nodes": f"""{_VALUES},
        messages AS (SELECT DISTINCT actor, message FROM typed WHERE type_text IS NOT NULL)
        SELECT actor, message, path, tags, optional FROM messages JOIN (VALUES
          ('order', '$', 'object', false), ('order', '$."\\"id\\""', 'number', false),
          ('order', '$."\\"note\\""', 'null | string', true), ('order', '$."\\"tags\\""', 'array', false),
          ('order', '$."\\"tags\\""[]', 'map | never | number | string', false),
          ('order', '$."\\"tags\\""[]{{k}}', 'string', false), ('order', '$."\\"tags\\""[]{{v}}', 'bool', false),
          ('lit', '$', 'object', false), ('lit', '$.id', 'number', false), ('lit', '$.when', 'Date', false),
          ('lit', '$.re', 'regexp', false), ('lit', '$."\\"q\\""', 'array', false),
          ('lit', '$."\\"q\\""[]', 'bool | null | number | undefined', false)
        ) v(message, path, tags, optional) USING (message)""".replace("{{", "{").replace("}}", "}"),
    "x1_stream_type_uses": f"WITH {_events(tables.EVENT_LINES)} "
    "SELECT raw_type, actor, message, kind FROM uses",
    "x2_stream_reports": f"WITH {_events(tables.EVENT_LINES)} "
    "SELECT substr(msg, 28) AS fallback, count(*) AS events FROM records "
    "WHERE module = 'JSIPCSerializer' AND msg LIKE 'UntypedFromJSVal fallback: _%' GROUP BY ALL",
    "x2_stream_serializer": f"WITH {_events(tables.EVENT_LINES)} "
    "SELECT msg, count(*) AS events FROM records WHERE module = 'JSIPCSerializer' "
    "AND msg NOT LIKE 'UntypedFromJSVal fallback: _%' GROUP BY ALL",
    "x2_stream_others": f"WITH {_events(tables.EVENT_LINES)} "
    "SELECT module || ': ' || msg AS text, count(*) AS events FROM records "
    "WHERE module NOT IN ('JSIPCTypeSend', 'JSIPCSerializer') GROUP BY ALL",
}

# The stream comes to the catalog of the whole log.
ORACLES["x3_stream_catalog"] = ORACLES["c12_discover"]
ORACLES["x4_stream_value_types"] = f"""
    SELECT actor, message, n_types, type_text,
           dense_rank() OVER (PARTITION BY actor ORDER BY message_line) AS message_rank
    FROM ({ORACLES["v7_value_type_report"]}) report"""
ORACLES["x2_stream_failures"] = f"""
    SELECT failure, count(*) AS events FROM (
      SELECT regexp_extract(line, 'Type checking failed: (.*)$', 1) AS failure FROM ({tables.EVENT_LINES}) lines
      WHERE line LIKE '%Type checking failed: %') failures GROUP BY failure"""


def _written(name):
    """A document's lines in order; a line of the catalog may hold several."""
    return f"""
        SELECT row_number() OVER (ORDER BY section, actor, step, message, part) AS line_no, text AS line
        FROM (SELECT section, actor, step, message, unnest(string_split(line, chr(10))) AS text,
                     generate_subscripts(string_split(line, chr(10)), 1) AS part
              FROM ({ORACLES[name]}) document) parts"""


ORACLES["c8_written_json"] = _written("c8_write_catalog_json")
ORACLES["c9_written_ts"] = _written("c9_write_catalog_ts")
ORACLES["c10_written_text"] = _written("c10_write_catalog_text")
ORACLES["c12_discover_reports"] = f"""
    SELECT 'fallbacks' AS report, fallback AS text, events AS number FROM ({ORACLES["a3_fallback_counts"]}) a3
    UNION ALL SELECT 'serializer', msg, events FROM ({ORACLES["a4_serializer_counts"]}) a4
    UNION ALL SELECT 'malformed', substr(error, 24), count(*) FROM ({ORACLES["e3_malformed_events"]}) e3 GROUP BY ALL
    UNION ALL SELECT 'others', text, NULL FROM ({ORACLES["a5_other_messages"]}) a5
    UNION ALL SELECT 'failed', actor || ' ' || message, line_no FROM ({ORACLES["e6_failed_types"]}) e6
    UNION ALL SELECT 'combined', actor || ' ' || message || ' ' || input_ts, n_types
              FROM ({ORACLES["t11_combine_log"]}) t11"""
