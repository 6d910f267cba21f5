"""Log-shaped tables derived from the test tables, as SQL both engines run.

Every table grows with the table it comes from; texts are used whole.
"""

TABLES = ["customer", "documents", "conversations", "events", "orders", "supplier", "part", "lineitem"]

# Whole documents and turns, as noise every extraction has to drop.
_NOISE = """
    UNION ALL SELECT 100000000000 + doc_id AS line_no, text AS line FROM documents
    UNION ALL SELECT 200000000000 + conv_id * 1000 + turn AS line_no, text AS line
              FROM conversations"""

# Seven raw types, five actors, all routes.
EVENT_LINES = """
    SELECT event_id AS line_no,
      CASE
       WHEN event_id % 211 = 0 THEN 'unrelated console noise ' || CAST(event_id AS VARCHAR(20))
       WHEN event_id % 151 = 0 THEN '[Parent 1: Main Thread]: D/JSIPCSerializer UntypedFromJSVal fallback: ' || event_type
       WHEN event_id % 149 = 0 THEN '[Parent 1: Main Thread]: D/JSIPCSerializer note u' || CAST(user_id % 3 AS VARCHAR(20))
       WHEN event_id % 139 = 0 THEN '[Parent 1: Main Thread]: D/JSIPCTypeChecking Type checking failed: ' || event_type
       WHEN event_id % 137 = 0 THEN '[Parent 1: Main Thread]: D/JSIPCTypeSend garbage'
       ELSE '[Parent 1: Main Thread]: D/JSIPCTypeSend JSIT Send ACTOR ' || event_type
         || ' MESSAGE M:' || CAST(user_id % 5 AS VARCHAR(20))
         || ' KIND ' || CASE
              WHEN user_id % 5 < 2 THEN 'Message'
              WHEN user_id % 5 = 2 THEN 'Query'
              WHEN user_id % 5 = 3 THEN CASE WHEN event_id % 2 = 0 THEN 'Query' ELSE 'QueryResolve' END
              ELSE CASE WHEN event_id % 3 = 0 THEN 'Query' WHEN event_id % 3 = 1 THEN 'QueryResolve' ELSE 'QueryReject' END
            END
         || ' TYPE ' || CASE
              WHEN event_id % 97 = 0 THEN 'FAILED'
              WHEN event_id % 89 = 0 THEN 'NO VALUE'
              WHEN event_id % 7 = 0 THEN '{k: number}'
              WHEN event_id % 7 = 1 THEN '{k: number; v?: number}'
              WHEN event_id % 7 = 2 THEN '{k: number; v: string}'
              WHEN event_id % 7 = 3 THEN '{a: number; b: string; c: null}'
              WHEN event_id % 7 = 4 THEN 'Array<number> | Array<string>'
              WHEN event_id % 7 = 5 THEN 'undefined'
              ELSE '{k: string} | {k: number; tags: Array<string>}'
            END
      END AS line
    FROM events"""
LOG_LINES = EVENT_LINES + _NOISE

# Types whose number grows with the orders: seven properties always, six
# sometimes, so that any two of them have more than half of their names shared.
ORDER_PARTS = """
    SELECT o_orderkey AS k, o_custkey AS c,
      'Order' || o_orderstatus AS actor,
      'P:' || substr(o_orderpriority, 1, 1) AS message,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2', '3') THEN 0
           WHEN substr(o_orderpriority, 1, 1) = '4' THEN 1
           WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS kind,
      CASE o_custkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'string'
                         WHEN 2 THEN 'null' ELSE 'boolean' END AS a,
      o_orderkey % 3 = 0 AS b_two,
      o_orderkey % 23 = 0 AS c_two,
      CASE WHEN o_orderkey % 2 = 0 THEN 'number' ELSE 'string' END AS c_one,
      CASE o_custkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'string' ELSE 'undefined' END AS x,
      o_orderkey % 13 = 0 AS has_z,
      o_orderkey % 19 = 0 AS g_two,
      o_custkey % 2 = 0 AS has_p,
      o_custkey % 3 = 0 AS has_q,
      o_custkey % 5 = 0 AS has_r,
      o_orderkey % 7 = 0 AS has_s,
      o_orderkey % 11 = 0 AS has_t,
      o_custkey % 17 = 0 AS has_12
    FROM orders"""

ORDER_TYPES = f"""
    SELECT *,
      '{{a: ' || a || '; b: ' || CASE WHEN b_two THEN 'string | number' ELSE 'number' END
      || '; c: ' || CASE WHEN c_two THEN 'Array<number> | Array<string>'
                         ELSE 'Array<' || c_one || '>' END
      || '; d: number; e: {{x: ' || x || '; y: null' || CASE WHEN has_z THEN '; z?: number' ELSE '' END
      || '}}; f: string; g: ' || CASE WHEN g_two THEN '{{k: string}} | {{k: string; l: number}}'
                                     ELSE '{{k: string}}' END
      || CASE WHEN has_p THEN '; p: number' ELSE '' END
      || CASE WHEN has_q THEN '; q?: string' ELSE '' END
      || CASE WHEN has_r THEN '; r: Set<number>' ELSE '' END
      || CASE WHEN has_s THEN '; s: Map<string, any>' ELSE '' END
      || CASE WHEN has_t THEN '; t: testOnly' ELSE '' END
      || CASE WHEN has_12 THEN '; 12: null' ELSE '' END || '}}' AS raw_type
    FROM ({ORDER_PARTS}) parts"""

ORDER_LINES = f"""
    SELECT k AS line_no,
      '[Child 7: Main Thread]: D/JSIPCTypeSend JSIT Recv ACTOR ' || actor || ' MESSAGE ' || message
      || ' KIND ' || CASE kind WHEN 0 THEN 'Message' WHEN 1 THEN 'Query' ELSE 'QueryResolve' END
      || ' TYPE ' || raw_type AS line
    FROM ({ORDER_TYPES}) typed"""

# One type per actor, kinds that clash, and names that are not allowed.
CUSTOMER_TYPES = """
    SELECT c_custkey AS k,
      CASE WHEN c_nationkey = 12 THEN 'TestWindow'
           WHEN c_nationkey % 10 = 9 THEN 'bad-C' || CAST(c_nationkey AS VARCHAR(20))
           ELSE 'C' || CAST(c_nationkey AS VARCHAR(20)) END AS actor,
      'E:' || c_mktsegment AS message,
      CASE c_nationkey % 5
        WHEN 0 THEN 'Message'
        WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Message' ELSE 'Query' END
        WHEN 2 THEN 'QueryReject'
        WHEN 3 THEN CASE c_custkey % 3 WHEN 0 THEN 'Query' WHEN 1 THEN 'QueryResolve' ELSE 'QueryReject' END
        ELSE 'Query' END AS kind_word,
      CASE c_nationkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN '{id: number; name?: string}'
                           ELSE 'Array<string>' END AS raw_type,
      CASE c_nationkey % 3 WHEN 0 THEN '"number"'
        WHEN 1 THEN '["object", ["id", "number"], ["name", "string", true]]'
        ELSE '["array", "string"]' END AS json
    FROM customer"""

CUSTOMER_LINES = f"""
    SELECT k AS line_no,
      '[Parent 3: IPC]: D/JSIPCTypeSend JSIT Send ACTOR ' || actor || ' MESSAGE ' || message
      || ' KIND ' || kind_word || ' TYPE ' || raw_type AS line
    FROM ({CUSTOMER_TYPES}) typed"""

# Logged values: JSON, other literals, payloads that are neither.
VALUE_PARTS = """
    SELECT o_orderkey * 2 AS line_no, 'Prio' || substr(o_orderpriority, 1, 1) AS actor,
      'order' AS message, o_orderkey AS k,
      '{"id": ' || CAST(o_orderkey AS VARCHAR(20))
      || CASE WHEN o_orderkey % 3 = 0 THEN ', "note": "x' || CAST(o_custkey AS VARCHAR(20)) || '"'
              WHEN o_orderkey % 3 = 1 THEN ', "note": null' ELSE '' END
      || ', "tags": ' || CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[1, 2]'
                                             WHEN 2 THEN '["a", 1]' ELSE '[{"p": true}]' END
      || '}' AS contents
    FROM orders
    UNION ALL
    SELECT o_orderkey * 2 + 1 AS line_no,
      CASE WHEN o_orderkey % 31 = 0 THEN 'DevToolsFrame'
           ELSE 'Prio' || substr(o_orderpriority, 1, 1) END AS actor,
      CASE WHEN o_orderkey % 31 = 0 THEN 'DevToolsFrameChild:packet' ELSE 'lit' END AS message,
      o_orderkey AS k,
      CASE WHEN o_orderkey % 97 = 0 THEN 'new Foo(' || CAST(o_orderkey AS VARCHAR(20)) || ')'
           ELSE '({id:' || CAST(o_orderkey AS VARCHAR(20)) || ', when:(new Date(' || CAST(o_custkey AS VARCHAR(20))
                || ')), re:/a' || CAST(o_custkey % 9 AS VARCHAR(20)) || '/, ''q'':[true, null, Infinity, (void 0)]})'
      END AS contents
    FROM orders"""

LOGGED_VALUES = f"""
    SELECT line_no, '[Child 7]: QQQ ACTOR ' || actor || ' MESSAGE ' || message
      || ' CONTENTS ' || contents AS line
    FROM ({VALUE_PARTS}) parts"""
VALUE_LINES = LOGGED_VALUES + _NOISE

# Payloads keyed by ids: maps in JSON and in literals, maps of maps, objects that are none, a label twice.
KEYED_VALUES = """
    SELECT k AS line_no, '[Child 9]: QQQ ACTOR Keyed' || status || ' MESSAGE m' || CAST(k % 5 AS VARCHAR(20)) || ' CONTENTS '
      || CASE k % 5
           WHEN 0 THEN '{"' || a || '": {"total": ' || a || ', "open": true}, "' || b || '": {"total": 7, "open": true}}'
           WHEN 1 THEN '({' || a || ': [''x''], ' || b || ': [''y' || a || ''']})'
           WHEN 2 THEN '{"u' || a || '": {"v' || a || '": 1, "w": 2}, "u": {"x' || b || '": 3}}'
           WHEN 3 THEN '{"' || a || '": 1, "' || b || '": "s"}'
           ELSE '{"' || a || '": 1, "' || a || '": 2}' END AS line, k, status, a, b
    FROM (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR(20)) AS a,
            CAST(o_orderkey + 1 AS VARCHAR(20)) AS b FROM orders) keyed"""

# Declaration files: two suppliers to an actor, some files with an error.
DECLARED_FILES = """
    SELECT s_suppkey AS file_rank, 'decl/' || CAST(s_suppkey AS VARCHAR(20)) || '.ts' AS file,
      'type MessageTypes = {' || chr(10) || '  '
      || CASE WHEN s_suppkey % 7 = 3 THEN '''3A''' ELSE 'Sup' || CAST(CAST(floor(s_suppkey / 2) AS BIGINT) AS VARCHAR(20)) END
      || ': { // supplier' || chr(10) || '    M: number | null;' || chr(10)
      || '    ''N:' || CAST(s_nationkey AS VARCHAR(20)) || ''': (_: string) => '
      || CASE WHEN s_suppkey % 11 = 5 THEN 'Array<>' ELSE '{k?: number}' END || ';' || chr(10)
      || CASE WHEN s_suppkey % 13 = 6 THEN '    M: (_: never) => any,' || chr(10) ELSE '' END
      || '  },' || chr(10) || '  W' || CAST(s_suppkey AS VARCHAR(20)) || ': testOnly' || chr(10) || '};'
      || chr(10) AS text
    FROM supplier"""

# Each customer's first orders, by status, are the first appearances of three shapes.
OVERLAPPING_TYPES = """
    SELECT 'c' || CAST(o_custkey AS VARCHAR(20)) AS actor, min(o_orderkey) AS first_seen,
      CASE o_orderstatus WHEN 'F' THEN '{a: number; b: number; c: number}'
        WHEN 'O' THEN '{b: number; c: number; d: number}'
        ELSE '{c: number; d: number; e: number}' END AS raw_type
    FROM orders GROUP BY o_custkey, o_orderstatus"""

# A type as deep as the part is large, per maker; all of one maker are merged.
DEEP_TYPES = """
    SELECT DISTINCT 'm' || CAST(l_suppkey AS VARCHAR(20)) AS actor,
      repeat('Array<', CAST(l_linenumber % 4 + 5 AS INT)) || '{v: number}'
        || repeat('>', CAST(l_linenumber % 4 + 5 AS INT)) AS raw_type
    FROM lineitem"""
