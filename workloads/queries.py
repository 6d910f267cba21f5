"""One query per operator: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelog.operators import catalog as cat
from shapelog.operators import dedupe, extract, nodes, reports, unions, values, writers
from shapelog.operators.declare import parse_declarations
from shapelog.plans import discover as disc
from shapelog.plans import failures, infer, translate
from shapelog.session import checkpoint_folder, durable
from shapelog.sources import declarations, logs, overrides
from shapelog.streaming import catalog as live
from shapelog.streaming import streams
from shapelog.streaming import values as live_values
from workloads import tables

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- inputs ---------------------------------------------------------------


def table(spark, folder, sql):
    for name in tables.TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def lines(spark, folder, sql=tables.LOG_LINES, source="log"):
    return logs.lines_of(table(spark, folder, sql), source, "line_no", "line")


def records(spark, folder):
    return extract.extract_records(lines(spark, folder))


def events(spark, folder):
    return extract.extract_type_events(records(spark, folder))


def uses_of(line_table):
    return dedupe.distinct_type_uses(streams.type_events(line_table))


def grouped_of(line_table):
    uses = durable(uses_of(line_table))  # read three times below
    raw = dedupe.distinct_raw_types(uses)
    return dedupe.group_types(uses, raw.join(unions.simplify_types(raw), "raw_type"))


def united_of(line_table):
    return unions.union_types(grouped_of(line_table))


def order_lines(spark, folder):
    return lines(spark, folder, tables.ORDER_LINES)


def customer_lines(spark, folder):
    return lines(spark, folder, tables.CUSTOMER_LINES)


def order_catalog(spark, folder):
    return cat.build_catalog(cat.unify_kinds(united_of(order_lines(spark, folder))))


def customer_catalog(spark, folder):
    return cat.build_catalog(cat.unify_kinds(united_of(customer_lines(spark, folder))))


def value_events(spark, folder):
    found = extract.extract_value_events(lines(spark, folder, tables.VALUE_LINES))
    return extract.exclude_rules(found, infer.VALUE_EXCLUSIONS)


def payload_types(spark, folder):
    payloads = durable(values.distinct_payloads(value_events(spark, folder)))
    return values.infer_value_types(payloads)


def scratch(spark, name):
    """A new folder where the cluster keeps its checkpoints."""
    return os.path.join(checkpoint_folder(spark), f"{name}-{uuid.uuid4().hex}")


def line_no(df):
    return df.withColumnRenamed("mid", "line_no")


# --- sources --------------------------------------------------------------


@query
def s1_read_logs(spark, folder):
    path = scratch(spark, "s1")
    table(spark, folder, tables.EVENT_LINES).repartitionByRange("line_no").sortWithinPartitions(
        "line_no"
    ).select("line").write.text(path)
    return logs.read_logs(spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query
def s2_stream_logs(spark, folder):
    path, out = scratch(spark, "s2"), scratch(spark, "s2-out")
    table(spark, folder, tables.EVENT_LINES).select("line").write.text(path)
    stream = extract.extract_records(logs.stream_logs(spark, path)).select("module", "msg")
    to_parquet(stream, out)
    return spark.read.parquet(out).groupBy("module", "msg").agg(F.count(F.lit(1)).alias("n"))


@query
def s3_read_declarations(spark, folder):
    path = scratch(spark, "s3")
    files = table(spark, folder, tables.DECLARED_FILES)
    # A file costs the same whatever its size: tasks coalesced by bytes would be one.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files.select("file_rank", F.rtrim(F.col("text"), F.lit("\n")).alias("text")).repartition(
        tasks, "file_rank"
    ).write.partitionBy("file_rank").text(path)
    read = declarations.read_declarations(spark, path)
    rank = F.regexp_extract("file", r"file_rank=(\d+)", 1).cast("bigint")
    return read.select(rank.alias("file_rank"), "text")


@query
def s4_read_overrides(spark, folder):
    path = scratch(spark, "s4")
    rows = table(
        spark,
        folder,
        "SELECT 'Part' || CAST(p_partkey AS VARCHAR(20)) AS actor, p_name AS message, "
        "1 AS arity, 'any' AS slot0, CASE WHEN p_size > 25 THEN p_type END AS comment FROM part",
    )
    rows.write.json(path)
    return overrides.read_overrides(spark, path)


# --- extraction -----------------------------------------------------------


@query
def e1_extract_records(spark, folder):
    return line_no(records(spark, folder)).select("line_no", "module", "msg")


EVENT = ["line_no", "actor", "message", "kind", "raw_type"]


@query
def e2_extract_type_events(spark, folder):
    return line_no(events(spark, folder)).select(*EVENT, "direction")


@query
def e3_malformed_events(spark, folder):
    return line_no(extract.malformed_events(records(spark, folder))).select("line_no", "error")


@query
def e4_kind_code(spark, folder):
    counted = events(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("events"))
    return counted


@query
def e5_drop_no_value(spark, folder):
    return line_no(extract.drop_no_value(events(spark, folder))).select(*EVENT)


@query
def e6_failed_types(spark, folder):
    return line_no(extract.failed_types(events(spark, folder))).select("line_no", "actor", "message")


@query
def e7_ignore_actors(spark, folder):
    return line_no(extract.ignore_actors(events(spark, folder), ["click", "no such"])).select(*EVENT)


@query
def e7_ignored_actors_seen(spark, folder):
    return extract.ignored_actors_seen(events(spark, folder), ["click", "view", "no such"])


@query
def e8_exclude_rules(spark, folder):
    rules = [("click", "M:3", 2), ("view", "M:0", None)]
    return line_no(extract.exclude_rules(events(spark, folder), rules)).select(*EVENT)


@query
def e9_fallback_events(spark, folder):
    return line_no(extract.fallback_events(records(spark, folder))).select("line_no", "fallback")


@query
def e10_serializer_events(spark, folder):
    return line_no(extract.serializer_events(records(spark, folder))).select("line_no", "msg")


@query
def e11_other_records(spark, folder):
    return line_no(extract.other_records(records(spark, folder))).select("line_no", "text")


@query
def e12_extract_value_events(spark, folder):
    found = extract.extract_value_events(lines(spark, folder, tables.VALUE_LINES))
    return line_no(found).select("line_no", "actor", "message", "contents")


@query
def e13_exclude_value_rules(spark, folder):
    return line_no(value_events(spark, folder)).select("line_no", "actor", "message", "contents")


@query
def e14_extract_check_failures(spark, folder):
    return line_no(extract.extract_check_failures(lines(spark, folder))).select("line_no", "failure")


# --- grouping and reports ---------------------------------------------------


@query
def a1_distinct_type_uses(spark, folder):
    return uses_of(lines(spark, folder)).select(
        *dedupe.USE, F.col("first_seen.mid").alias("first_line"), "events"
    )


@query
def a1_distinct_order_uses(spark, folder):
    return uses_of(order_lines(spark, folder)).select(
        *dedupe.USE, F.col("first_seen.mid").alias("first_line"), "events"
    )


@query
def a2_group_types(spark, folder):
    return grouped_of(lines(spark, folder)).select(
        "actor", "message", "kind", "type_ts", F.col("raw_first_seen.mid").alias("raw_first_line")
    )


@query
def a3_fallback_counts(spark, folder):
    return reports.fallback_counts(extract.fallback_events(records(spark, folder)))


@query
def a4_serializer_counts(spark, folder):
    return reports.serializer_counts(extract.serializer_events(records(spark, folder)))


@query
def a5_other_messages(spark, folder):
    return reports.other_messages(extract.other_records(records(spark, folder)))


def file_lines(spark, folder):
    """The event lines, spread over ten log files."""
    numbered = table(spark, folder, tables.EVENT_LINES)
    name = F.concat(F.lit("runs/log-"), (F.col("mid") % 10).cast("string"), F.lit(".txt"))
    return logs.lines_of(numbered, "", "line_no", "line").withColumn("file_path", name)


@query
def a6_failure_files(spark, folder):
    found = extract.extract_check_failures(file_lines(spark, folder))
    return reports.failure_files(found)


@query
def a7_strip_common_prefix(spark, folder):
    found = file_lines(spark, folder)
    files = found.select("file_path").distinct()
    return reports.strip_common_prefix(files, "file_path", files)


@query
def a8_name_chars(spark, folder):
    return reports.name_chars(order_catalog(spark, folder).unionByName(customer_catalog(spark, folder)))


# --- types ------------------------------------------------------------------


@query
def t1_parse_types(spark, folder):
    raw = table(spark, folder, tables.ORDER_TYPES)
    return unions.parse_types(raw).select("raw_type", "type_json", "type_ts")


@query
def t2_simplify_types(spark, folder):
    raw = table(spark, folder, tables.ORDER_TYPES)
    return unions.simplify_types(raw).select("raw_type", "type_json", "type_ts")


@query
def t3_union_types(spark, folder):
    return united_of(order_lines(spark, folder)).select(
        "actor", "message", "kind", "type_ts", "n_types"
    )


@query
def t3_union_in_order(spark, folder):
    """Three overlapping shapes, of which the first two to come decide the union."""
    raw = table(spark, folder, tables.OVERLAPPING_TYPES)
    typed = raw.join(unions.parse_types(raw), "raw_type")
    united = unions.union_types(typed, keys=["actor"], order=["first_seen"])
    return united.select("actor", "type_json", "type_ts", "n_types")


@query
def t3_union_event_types(spark, folder):
    return united_of(lines(spark, folder)).select(
        "actor", "message", "kind", "type_ts", "n_types"
    )


def order_states(spark, folder):
    raw = table(spark, folder, tables.ORDER_TYPES).select("raw_type").distinct()
    return unions.parse_types(raw).select("raw_type", "type_state")


@query
def t4_mergeable_shapes(spark, folder):
    """Each logged shape against the first shape of its message."""
    shaped = table(spark, folder, SHAPES)
    first = shaped.groupBy("actor").agg(F.min_by("names", "k").alias("names_b"))
    pairs = shaped.select("k", "actor", F.col("names").alias("names_a")).join(first, "actor")
    return nodes.mergeable_shapes(pairs).select("k", "actor", "mergeable")


@query
def t4_mergeable_pairs(spark, folder):
    """All pairs of shapes of a message that may be one."""
    return nodes.mergeable_pairs(table(spark, folder, SHAPES), ["actor"]).select(
        "actor", F.array_join("names_a", " ").alias("names_a"), F.array_join("names_b", " ").alias("names_b")
    )


SHAPES = """
    SELECT event_id AS k, event_type AS actor,
      array_distinct(array('n' || CAST(event_id % 3 AS VARCHAR(20)), 'n' || CAST(event_id % 5 AS VARCHAR(20)),
            'n' || CAST(user_id % 7 AS VARCHAR(20)), 'n' || CAST(user_id % 4 AS VARCHAR(20)))) AS names
    FROM events"""


@query
def t11_combine_log(spark, folder):
    found = lines(spark, folder)
    grouped = durable(grouped_of(found))
    return unions.combine_log(grouped, unions.union_types(grouped))


@query
def t12_type_nodes(spark, folder):
    return nodes.type_nodes(order_states(spark, folder)).select(
        "raw_type", "path", "parent_path", "tag", "name", "optional", "pos"
    )


def merged_orders(spark, folder):
    """The places of all types of each message; the union needs no order."""
    uses = uses_of(order_lines(spark, folder)).select(*dedupe.USE)
    keyed = uses.join(nodes.with_nodes(order_states(spark, folder)), "raw_type")
    return nodes.merge_nodes(keyed.select(*unions.MESSAGE_KIND, F.inline("nodes")), unions.MESSAGE_KIND)


@query
def t13_merge_nodes(spark, folder):
    return merged_orders(spark, folder).select(
        *unions.MESSAGE_KIND, "path", "name",
        F.array_join("tags", " | ").alias("tags"), "optional", "present",
    )


@query
def t13_merged_types(spark, folder):
    return nodes.merged_types(merged_orders(spark, folder), unions.MESSAGE_KIND)


@query
def t13_merged_deep_types(spark, folder):
    """Arrays nested up to 8 deep, as deep as each part's size tells."""
    raw = table(spark, folder, tables.DEEP_TYPES)
    typed = raw.join(unions.parse_types(raw), "raw_type").select("actor", "type_state")
    return nodes.merged_types(nodes.merge_nodes(nodes.type_nodes(typed), ["actor"]), ["actor"])


# --- catalog ----------------------------------------------------------------

SLOTS = ["actor", "message", "arity", "slot0", "slot1"]


@query
def c1_unify_kinds(spark, folder):
    united = united_of(customer_lines(spark, folder))
    return cat.unify_kinds(united).select(*SLOTS, "error")


@query
def c2_validate_messages(spark, folder):
    return cat.validate_messages(cat.unify_kinds(united_of(customer_lines(spark, folder))))


@query
def c3_build_catalog(spark, folder):
    return order_catalog(spark, folder).select(*SLOTS)


GOOD_OVERRIDES = [
    ("OrderF", "P:1", 1, "any", None, "c1"),
    ("OrderF", "P:5", 2, None, "any", "c2"),
    ("OrderO", None, 1, "testOnly", None, ""),
    ("newActor", "X", 1, "undefined", None, "c3"),
]
# Of these only the first may be applied.
BAD_OVERRIDES = [
    ("C0", "E:FURNITURE", 1, "any", None, "good"),
    ("C0", "E:AUTOMOBILE", 2, "any", None, "c1"),
    ("C0", "E:BUILDING", 1, "any", None, ""),
    ("C4", "E:AUTOMOBILE", 2, None, None, "c2"),
    ("C5", None, 1, "any", None, ""),
    ("B-2", "M", 1, "any", None, "c3"),
    ("C0", "3 x", 1, "any", None, "c4"),
    ("C10", "E:BUILDING", 1, "any", None, "c5"),
    ("C10", "E:BUILDING", 1, "string", None, "c6"),
    ("C15", None, 1, "any", None, "c7"),
    ("C15", "E:BUILDING", 1, "any", None, "c8"),
]


@query
def c4_apply_overrides(spark, folder):
    laid = cat.typed_overrides(overrides.read_overrides(spark, GOOD_OVERRIDES))
    return cat.apply_overrides(order_catalog(spark, folder), laid).select(*SLOTS, "comment")


def bad_overrides(spark, folder):
    found = durable(customer_catalog(spark, folder))
    laid = cat.typed_overrides(overrides.read_overrides(spark, BAD_OVERRIDES))
    return found, laid, cat.validate_overrides(found, laid)


@query
def c4_apply_accepted_overrides(spark, folder):
    """What is rejected is not applied."""
    found, laid, bad = bad_overrides(spark, folder)
    return cat.apply_overrides(found, cat.accepted_overrides(laid, bad)).select(*SLOTS, "comment")


@query
def c5_validate_overrides(spark, folder):
    return bad_overrides(spark, folder)[2]


@query
def c6_parse_declarations(spark, folder):
    return parse_declarations(table(spark, folder, tables.DECLARED_FILES)).select(
        "file", "actor", "message", "actor_line", "line", "arity", "slot0", "slot1", "error"
    )


@query
def c7_merge_catalogs(spark, folder):
    _, errors = translate.declared_catalog(table(spark, folder, tables.DECLARED_FILES))
    return errors.select("file", "error")


@query
def c8_write_catalog_json(spark, folder):
    return writers.json_lines(customer_catalog(spark, folder))


@query
def c9_write_catalog_ts(spark, folder):
    return writers.ts_lines(customer_catalog(spark, folder))


@query
def c10_write_catalog_text(spark, folder):
    return writers.text_lines(customer_catalog(spark, folder))


def written(spark, folder, write):
    """The document that a sink wrote, read back: its part files in name order, their lines numbered."""
    path = scratch(spark, "catalog")
    write(customer_catalog(spark, folder), path)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", r"\n\z", ""), "\n").alias("lines")
    )
    # One row per part file, not per line.
    ahead = files.select("file", (F.sum(F.size("lines")).over(Window.orderBy("file")) - F.size("lines")).alias("ahead"))
    return files.join(ahead, "file").select("ahead", F.posexplode("lines").alias("n", "line")).select(
        (F.col("ahead") + F.col("n") + 1).alias("line_no"), "line"
    )


@query
def c8_written_json(spark, folder):
    return written(spark, folder, writers.write_catalog_json)


@query
def c9_written_ts(spark, folder):
    return written(spark, folder, writers.write_catalog_ts)


@query
def c10_written_text(spark, folder):
    return written(spark, folder, writers.write_catalog_text)


@query
def c11_translate_declarations(spark, folder):
    catalog, _ = translate.declared_catalog(table(spark, folder, tables.DECLARED_FILES))
    return catalog.select("actor", "message", "arity", "slot0_json", "slot1_json")


@query
def c12_discover(spark, folder):
    options = disc.Options(ignore_errors=True, overrides=False)
    return disc.discover_lines(lines(spark, folder), options).catalog.select(*SLOTS)


@query
def c12_discover_reports(spark, folder):
    """All lists and counts of a discovery, as its sink wrote them."""
    path = scratch(spark, "reports")
    options = disc.Options(ignore_errors=True, overrides=False)
    disc.discover_lines(lines(spark, folder), options).write_reports(path)
    found = disc.read_reports(spark, path)
    text = {
        "fallbacks": F.col("fallback"), "serializer": F.col("msg"), "malformed": F.col("msg"), "others": F.col("text"),
        "failed": F.concat_ws(" ", "actor", "message"), "combined": F.concat_ws(" ", "actor", "message", "input_ts"),
    }
    number = {"failed": F.col("mid"), "combined": F.col("n_types"), "others": F.lit(None).cast("bigint")}
    rows = [
        found[name].select(F.lit(name).alias("report"), text[name].alias("text"), number.get(name, F.col("events")).alias("number"))
        for name in text
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def c12_discover_orders(spark, folder):
    options = disc.Options(overrides=GOOD_OVERRIDES)
    found = disc.discover_lines(order_lines(spark, folder), options)
    return found.catalog.select(*SLOTS, "comment")


@query
def c13_find_failures(spark, folder):
    found = file_lines(spark, folder)
    return failures.failures_in(found, found.select("file_path").distinct())


# --- values -----------------------------------------------------------------


@query
def v1_parse_payloads(spark, folder):
    parsed = values.parse_payloads(value_events(spark, folder))
    return line_no(parsed).select("line_no", "value", "error")


@query
def v2_infer_value_types(spark, folder):
    typed = payload_types(spark, folder)
    return typed.groupBy("actor", "message", "type_text").agg(F.sum("events").alias("events"))


@query
def v2_keyed_value_types(spark, folder):
    """Types of payloads keyed by ids, and how many payloads were read for each."""
    lines = logs.lines_of(table(spark, folder, tables.KEYED_VALUES), "log", "line_no", "line")
    payloads = durable(values.distinct_payloads(extract.extract_value_events(lines)))
    typed = values.infer_value_types(payloads)
    return typed.groupBy("actor", "message", "type_text").agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("payloads")
    )


@query
def v3_detect_map_objects(spark, folder):
    found = values.detect_map_objects(values.distinct_value_types(payload_types(spark, folder)))
    return found.groupBy("actor", "message", "path", "is_map", "key_type", "value_type").agg(
        F.count(F.lit(1)).alias("types")
    )


@query
def v3_detect_map_props(spark, folder):
    props = table(
        spark, folder,
        "SELECT event_id, event_type AS actor, 'props' AS message, props AS contents FROM events",
    )
    numbered = props.select(
        "actor", "message", "contents", F.lit("events").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"), F.col("event_id").alias("mid"),
    )
    typed = values.infer_value_types(values.distinct_payloads(numbered))
    found = values.detect_map_objects(values.distinct_value_types(typed))
    return found.select("actor", "path", "is_map", "key_type", "value_type")


@query
def v4_distinct_value_types(spark, folder):
    found = values.distinct_value_types(payload_types(spark, folder))
    return found.select(
        "actor", "message", "type_text", F.col("first_seen.mid").alias("first_line"), "events"
    )


@query
def v5_union_value_types(spark, folder):
    strict = values.distinct_value_types(payload_types(spark, folder))
    return values.union_value_types(strict).select("actor", "message", "type_text", "n_types")


@query
def v7_value_type_report(spark, folder):
    report = infer.infer_schemas(lines(spark, folder, tables.VALUE_LINES), mode="PERMISSIVE")
    return report.select(
        "actor", "message", "n_types", "type_text",
        F.col("actor_seen.mid").alias("actor_line"), F.col("message_seen.mid").alias("message_line"),
    )


@query
def v13_merge_value_nodes(spark, folder):
    """The always-merging union over value types."""
    strict = values.distinct_value_types(payload_types(spark, folder))
    rows = nodes.type_nodes(strict.select("actor", "message", "type_key", "node_state"), "node_state")
    merged = nodes.merge_nodes(rows, values.MESSAGE)
    return merged.select(
        "actor", "message", "path", F.array_join("tags", " | ").alias("tags"), "optional"
    )


# --- streams ----------------------------------------------------------------


def to_parquet(stream, out):
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


def line_stream(spark, folder):
    """The event lines as a stream of files."""
    path = scratch(spark, "lines")
    table(spark, folder, tables.EVENT_LINES).repartition(4).select("line").write.text(path)
    return logs.stream_logs(spark, path, maxFilesPerTrigger=2)


@query
def x1_stream_type_uses(spark, folder):
    out = scratch(spark, "x1")
    to_parquet(streams.stream_type_uses(line_stream(spark, folder)), out)
    return spark.read.parquet(out)


def running_report(spark, folder, name):
    """A running report, kept up by a stream to its end."""
    out = scratch(spark, "x2")
    found = streams.stream_reports(line_stream(spark, folder))[name]

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/{number % 2}")
        latest["path"] = f"{out}/{number % 2}"

    latest = {}
    running = (
        found.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out}-checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(keep)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(latest["path"])


@query
def x2_stream_reports(spark, folder):
    return running_report(spark, folder, "fallbacks")


@query
def x2_stream_serializer(spark, folder):
    return running_report(spark, folder, "serializer")


@query
def x2_stream_others(spark, folder):
    return running_report(spark, folder, "others")


@query
def x3_stream_catalog(spark, folder):
    """The catalog after the log's two halves, each taken up by the stream where it was left."""
    store = scratch(spark, "x3")
    in_halves(spark, table(spark, folder, tables.EVENT_LINES), live.stream_catalog, store)
    return live.stored_catalog(spark, store).select("actor", "message", "arity", "slot0", "slot1")


def in_halves(spark, found, start, store):
    """Write the log in two halves, in the order of its lines, and run the stream ``start`` after each.

    A half is as many sorted files as the session shuffles to, never a fixed number; the stream
    takes the new files as one batch, in which lines are ordered by path and place.
    """
    path = scratch(spark, "lines")
    middle = (found.agg(F.max("line_no")).first()[0] or 0) // 2
    for half in (F.col("line_no") <= middle, F.col("line_no") > middle):
        part = found.filter(half).repartitionByRange("line_no").sortWithinPartitions("line_no")
        part.select("line").write.mode("append").text(path)
        start(logs.stream_logs(spark, path), store, f"{store}-checkpoint").awaitTermination()


@query
def x4_stream_value_types(spark, folder):
    """The report of value types after the log's two halves; messages in the order they came."""
    store = scratch(spark, "x4")
    in_halves(spark, table(spark, folder, tables.LOGGED_VALUES), live_values.stream_values, store)
    report = live_values.stored_values(spark, store)
    came = F.dense_rank().over(Window.partitionBy("actor").orderBy("message_seen"))
    return report.select("actor", "message", "n_types", "type_text", came.alias("message_rank"))


@query
def x2_stream_failures(spark, folder):
    """Failures over all files; the stream counts them by file."""
    by_file = running_report(spark, folder, "failures")
    return by_file.groupBy("failure").agg(F.sum("events").alias("events"))
