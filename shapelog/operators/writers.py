"""Catalog sinks: JSON, TypeScript and a plain listing.

A document is a table of lines with the keys that put them in order.  Several
kinds of lines come from the same catalog, so that is written once before.  The
document is written by many tasks, split also inside a large actor.  The part files, in
name order, are the document.  ``single_file`` is for small catalogs: one task
sorts and writes all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapelog.operators.catalog import is_identifier
from shapelog.session import durable

_ORDER = ["section", "actor", "step", "message"]


def _with_ends(catalog: DataFrame) -> DataFrame:
    """Mark the last actor and the last message of each actor."""
    ends = catalog.groupBy("actor").agg(F.max("message").alias("last_message"))
    last_actor = catalog.agg(F.max("actor")).scalar()
    return catalog.join(ends, "actor").withColumns(
        {
            "is_whole": F.col("message").isNull(),
            "ends_actor": F.col("message") == F.col("last_message"),
            "ends_all": F.col("actor") == last_actor,
        }
    )


def _actor_lines(catalog: DataFrame, step: int, line: Column) -> DataFrame:
    """A line per actor that has messages."""
    actors = catalog.filter(~F.col("is_whole")).select("actor", "ends_all").distinct()
    return actors.select(
        F.lit(1).alias("section"), "actor", F.lit(step).alias("step"),
        F.lit("").alias("message"), line.alias("line"),
    )


def _message_lines(catalog: DataFrame, line: Column) -> DataFrame:
    return catalog.select(
        F.lit(1).alias("section"), "actor", F.lit(1).alias("step"),
        F.coalesce("message", F.lit("")).alias("message"), line.alias("line"),
    )


def _edge(df: DataFrame, section: int, text: str) -> DataFrame:
    row = [(section, "", 0, "", text)]
    return df.sparkSession.createDataFrame(
        row, "section int, actor string, step int, message string, line string"
    )


def _document(*parts: DataFrame) -> DataFrame:
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines.orderBy(*_ORDER)


def _comment(indent: str) -> Column:
    text = F.concat(F.lit(f"{indent}// "), "comment", F.lit("\n"))
    return F.when(F.col("comment") != "", text).otherwise("")


def json_lines(catalog: DataFrame) -> DataFrame:
    """``section, actor, step, message, line`` of the JSON document."""
    catalog = durable(catalog)
    rows = _with_ends(catalog)
    never = F.lit('"never"')
    pair = F.concat(
        F.coalesce("slot0_json", never), F.lit(", "), F.coalesce("slot1_json", never)
    )
    slots = F.when(F.col("arity") == 1, F.col("slot0_json")).otherwise(pair)

    def comma(last):
        return F.when(F.col(last), "").otherwise(",")

    line = F.when(
        F.col("is_whole"),
        F.concat(F.lit('  "'), "actor", F.lit('": '), "slot0_json", comma("ends_all")),
    ).otherwise(
        F.concat(
            F.lit('    "'), "message", F.lit('": ['), slots, F.lit("]"), comma("ends_actor")
        )
    )
    return _document(
        _edge(catalog, 0, "{"),
        _actor_lines(rows, 0, F.concat(F.lit('  "'), "actor", F.lit('": {'))),
        _message_lines(rows, line),
        _actor_lines(rows, 2, F.concat(F.lit("  }"), comma("ends_all"))),
        _edge(catalog, 2, "}"),
    )


def _slot_text() -> Column:
    never = F.lit("never")
    query = F.concat(
        F.lit("(_: "), F.coalesce("slot0", never), F.lit(") => "), F.coalesce("slot1", never)
    )
    return F.when(F.col("arity") == 1, F.col("slot0")).otherwise(query)


def ts_lines(catalog: DataFrame) -> DataFrame:
    """The lines of the TypeScript document."""
    catalog = durable(catalog)
    rows = catalog.withColumns({"is_whole": F.col("message").isNull(), "ends_all": F.lit(False)})
    quoted = F.when(is_identifier(F.col("message")), F.col("message")).otherwise(
        F.concat(F.lit('"'), "message", F.lit('"'))
    )
    line = F.when(
        F.col("is_whole"),
        F.concat(_comment("  "), F.lit("  "), "actor", F.lit(": "), "slot0", F.lit(";")),
    ).otherwise(
        F.concat(_comment("    "), F.lit("    "), quoted, F.lit(": "), _slot_text(), F.lit(";"))
    )
    return _document(
        _edge(catalog, 0, "type MessageTypes = {"),
        _actor_lines(rows, 0, F.concat(F.lit("  "), "actor", F.lit(": {"))),
        _message_lines(rows, line),
        _actor_lines(rows, 2, F.lit("  };")),
        _edge(catalog, 2, "};"),
    )


def text_lines(catalog: DataFrame) -> DataFrame:
    """The lines of the plain listing; an empty line ends each actor."""
    catalog = durable(catalog)
    rows = catalog.withColumns({"is_whole": F.col("message").isNull(), "ends_all": F.lit(False)})
    line = F.when(
        F.col("is_whole"),
        F.concat(_comment(""), "actor", F.lit("\n  "), "slot0", F.lit("\n")),
    ).otherwise(
        F.concat(_comment("  "), F.lit("  "), "message", F.lit(" : "), _slot_text())
    )
    return _document(
        _actor_lines(rows, 0, F.col("actor")),
        _message_lines(rows, line),
        _actor_lines(rows, 2, F.lit("")),
    )


def _write(lines: DataFrame, path: str, single_file: bool) -> None:
    if single_file:
        # One task sorts the whole document, spilling where it has to, and writes it.
        lines = lines.repartition(1).sortWithinPartitions(*_ORDER)
    lines.select("line").write.mode("overwrite").text(path)


def write_catalog_json(catalog: DataFrame, path: str, single_file=False) -> None:
    _write(json_lines(catalog), path, single_file)


def write_catalog_ts(catalog: DataFrame, path: str, single_file=False) -> None:
    _write(ts_lines(catalog), path, single_file)


def write_catalog_text(catalog: DataFrame, path: str, single_file=False) -> None:
    _write(text_lines(catalog), path, single_file)
