"""Discovery: from log lines to a catalog and its reports, in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog.functions.vocabulary import (
    FAILED,
    NO_VALUE,
    SERIALIZER_MODULE,
    TYPE_EXCLUSIONS,
    TYPE_MODULE,
)
from shapelog.operators import catalog as cat
from shapelog.operators import dedupe, extract, reports, unions, writers
from shapelog.session import durable, durable_parts
from shapelog.sources.logs import file_ranks, read_logs
from shapelog.sources.overrides import read_overrides


@dataclass
class Options:
    """How a discovery runs.

    ``overrides``: a table or rows, None for the default ones, False for none.
    ``ignore_errors``: keep bad rows as rejects instead of stopping at one.
    ``ignored``: actors to leave out.  ``exclusions``: (actor, message, kind).
    """

    overrides: DataFrame | Sequence | None | bool = None
    ignore_errors: bool = False
    ignored: Sequence[str] = ()
    exclusions: Sequence = field(default_factory=lambda: list(TYPE_EXCLUSIONS))

    @property
    def mode(self):
        return "PERMISSIVE" if self.ignore_errors else "FAILFAST"


@dataclass
class Discovery:
    """The catalog and the report tables of one run."""

    catalog: DataFrame
    combined: DataFrame
    rejected_types: DataFrame
    rejected_messages: DataFrame
    rejected_overrides: DataFrame | None
    malformed: DataFrame
    failed: DataFrame
    ignored: DataFrame
    fallbacks: DataFrame
    serializer: DataFrame
    others: DataFrame
    name_chars: DataFrame

    def write(self, path: str, form="text", single_file=False) -> None:
        """Write the catalog as ``text``, ``ts`` or ``json``."""
        sinks = {
            "text": writers.write_catalog_text,
            "ts": writers.write_catalog_ts,
            "json": writers.write_catalog_json,
        }
        sinks[form](self.catalog, path, single_file)

    def write_reports(self, path: str, form="parquet") -> None:
        """Write each report to a folder of its name; part files keep a report's order by their names."""
        for name in REPORTS:
            report = getattr(self, name)
            if report is not None:
                report.write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/{name}")


#: What a discovery tells besides the catalog.
REPORTS = (
    "combined", "rejected_types", "rejected_messages", "rejected_overrides", "malformed", "failed", "ignored",
    "fallbacks", "serializer", "others", "name_chars",
)


def read_reports(spark: SparkSession, path: str, form="parquet") -> dict[str, DataFrame]:
    """The reports that ``write_reports`` wrote, by name; without overrides there are none of theirs."""
    found = {}
    for name in REPORTS:
        try:
            found[name] = spark.read.format(form).load(f"{path.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def route_records(records: DataFrame, options: Options) -> DataFrame:
    """Each record that counts with its ``route``, its ``text`` and what it is about.

    One projection, so one pass over the log: type lines go through the filters
    in their fixed order, serializer lines are fallbacks or other notes, those of
    other modules are kept with their module.  Failed types are a list in log order,
    so each has its own ``row``.  With FAILFAST a malformed type line stops the job.
    """
    is_type = F.col("module") == TYPE_MODULE
    words = records.withColumn("word", extract.evaluate_once(F.split("msg", " ", 10)))
    word, good = F.col("word"), extract.is_type_event()
    actor, message, raw = F.get(word, F.lit(3)), F.get(word, F.lit(5)), F.get(word, F.lit(9))
    kind = extract.kind_code(F.get(word, F.lit(7)))
    fallback = F.regexp_extract("msg", extract.FALLBACK, 1)

    excluded = F.lit(False)
    for rule_actor, rule_message, rule_kind in options.exclusions:
        rule = (actor == rule_actor) & (message == rule_message)
        excluded |= rule if rule_kind is None else rule & (kind == rule_kind)

    malformed = F.lit("malformed")
    if options.mode == "FAILFAST":
        malformed = F.raise_error(F.concat(F.lit("Unknown JSIPCTypeSend: "), "msg")).cast("string")
    route = (
        F.when(is_type & ~good, malformed)
        .when(is_type & actor.isin(list(options.ignored)), "ignored")
        .when(is_type & (raw == NO_VALUE), "no_value")
        .when(is_type & (raw == FAILED), "failed")
        .when(is_type & excluded, "excluded")
        .when(is_type, "type")
        .when(F.col("module") != SERIALIZER_MODULE, "other")
        .when(fallback != "", "fallback")
        .otherwise("serializer")
    )
    routed = words.withColumn("route", extract.evaluate_once(route))
    about_type = F.col("route") == "type"
    failed = F.col("route") == "failed"
    other = F.when(F.col("route") == "other", F.concat_ws(": ", "module", "msg"))
    text = F.when(about_type, raw).when(F.col("route") == "fallback", fallback)
    return routed.filter(~F.col("route").isin("no_value", "excluded")).select(
        "route",
        F.when(failed | (F.col("route") == "ignored"), "").otherwise(F.coalesce(text, other, "msg")).alias("text"),
        F.when(is_type & (F.col("route") != "malformed"), actor).alias("actor"),
        F.when(about_type | failed, message).alias("message"),
        F.when(about_type, kind).alias("kind"),
        F.when(failed, F.col("mid")).alias("row"),
        "file_path",
        "block_start",
        "mid",
    )


def discover_lines(lines: DataFrame, options: Options | None = None, ranks=None) -> Discovery:
    """The whole log job over a table of lines.

    One pass reduces the log to its distinct records, counted and placed, and
    writes them to the shared folder, by route: the catalog and each report read
    their own route only, and nothing goes back to the log.  All but the failures, which
    are listed one by one, shrink before the shuffle.
    """
    options = options or Options()
    spark = lines.sparkSession
    records = extract.extract_records(lines)
    keys = ["route", "text", "actor", "message", "kind", "row"]
    summary = durable_parts(dedupe.first_positions(route_records(records, options), keys, ranks), "route")

    def routed(route):
        return summary.filter(F.col("route") == route)

    uses = routed("type").withColumnRenamed("text", "raw_type").drop("row")
    raw_types = dedupe.distinct_raw_types(uses)
    typed = durable(
        raw_types.join(unions.simplify_types(raw_types, mode=options.mode), "raw_type")
    )
    grouped = durable(dedupe.group_types(uses, typed.filter(F.col("error").isNull())))
    united = durable(unions.union_types(grouped))
    pivoted = cat.unify_kinds(united)
    found = cat.build_catalog(pivoted, options.mode)

    catalog, bad_overrides = found, None
    if options.overrides is not False:
        given = options.overrides
        if not isinstance(given, DataFrame):
            given = read_overrides(spark, given)
        overrides = durable(cat.typed_overrides(given))
        bad_overrides = durable(cat.validate_overrides(found, overrides))
        catalog = cat.apply_overrides(found, cat.accepted_overrides(overrides, bad_overrides))
        if options.mode == "FAILFAST":
            stop_on_first(bad_overrides)
    catalog = durable(catalog)

    def counted(route, name):
        rows = routed(route).groupBy(F.col("text").alias(name)).agg(F.sum("events").alias("events"))
        return rows.orderBy(F.desc("events"), F.desc(name))

    failed = routed("failed").select("actor", "message", "first_seen.*")
    failed = failed.orderBy("file_rank", "file_path", "block_start", "mid").drop("file_rank")
    return Discovery(
        catalog=catalog,
        combined=unions.combine_log(grouped, united),
        rejected_types=typed.filter(F.col("error").isNotNull()).select("raw_type", "error"),
        rejected_messages=cat.validate_messages(pivoted),
        rejected_overrides=bad_overrides,
        malformed=counted("malformed", "msg"),
        failed=failed,
        ignored=routed("ignored").select("actor").distinct(),
        fallbacks=counted("fallback", "fallback"),
        serializer=counted("serializer", "msg"),
        others=reports.other_messages(routed("other")),
        name_chars=reports.name_chars(catalog),
    )


def stop_on_first(errors: DataFrame) -> None:
    """Raise the first error in (actor, message) order, if there is one."""
    first = errors.orderBy("actor", "message").select("error").head()
    if first:
        raise ValueError(first[0])


def discover(spark: SparkSession, paths, options: Options | None = None) -> Discovery:
    """The whole log job over files; arguments keep their order."""
    ranks = file_ranks(spark, paths)
    return discover_lines(read_logs(spark, paths), options, ranks)
