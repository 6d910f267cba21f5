"""Declared catalogs to one JSON catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelog.operators.catalog import CATALOG, duplicate_declarations
from shapelog.operators.declare import parse_declarations
from shapelog.operators.writers import write_catalog_json
from shapelog.session import durable
from shapelog.sources.declarations import read_declarations
from shapelog.sources.logs import file_ranks


def declared_catalog(files: DataFrame):
    """``(catalog, errors)`` of a table of declaration files.

    Errors are in the order in which reading file after file meets them: what is
    wrong inside a file by line, then what is declared in an earlier file too.
    """
    declared = durable(parse_declarations(files))
    place = ["file_rank", "file", "elsewhere", "line"]
    at = F.expr("try_cast(substring_index(substring(error, length(file) + 2), ':', 1) AS bigint)")
    bad_files = declared.filter(F.col("error").isNotNull()).select(
        "file_rank", "file", F.lit(False).alias("elsewhere"), at.alias("line"), "error"
    )
    good = declared.filter(F.col("error").isNull())
    twice = duplicate_declarations(good).select(*place, "error")
    catalog = good.withColumn("comment", F.lit("")).select(*CATALOG)
    errors = bad_files.unionByName(twice).orderBy(*place, "error")
    return catalog, errors


def translate_declarations(spark: SparkSession, paths, out: str, single_file=False) -> DataFrame:
    """Read, merge and write; any error stops the job before it writes."""
    ranks = file_ranks(spark, paths).withColumnRenamed("file_path", "file")
    unranked = F.concat(F.lit("File is not among the inputs: "), "file")
    files = read_declarations(spark, paths).join(ranks, "file", "left").withColumn(
        "file_rank", F.coalesce("file_rank", F.raise_error(unranked).cast("bigint"))
    )
    catalog, errors = declared_catalog(files)
    first = errors.head()
    if first:
        raise ValueError(first["error"])
    write_catalog_json(catalog, out, single_file)
    return catalog
