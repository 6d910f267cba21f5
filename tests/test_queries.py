"""Every registered query against its SQL twin, on the small tables."""

import duckdb
import pytest

from workloads.oracles import ORACLES
from workloads.queries import QUERIES
from workloads.tables import TABLES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
# The SQL of these states the union of all raw types, which fewer rows do not have.
ALL_TYPES = (
    "t3_union_event_types", "t11_combine_log", "c12_discover", "v5_union_value_types", "v7_value_type_report",
    "v13_merge_value_nodes", "x3_stream_catalog",
    "x4_stream_value_types", "c12_discover_reports",
)


@pytest.fixture(scope="module")
def duck():
    made = {}
    for folder in (SMALL, LARGER):
        made[folder] = duckdb.connect()
        for name in TABLES:
            made[folder].execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return made


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows_as_sql(spark, duck, name):
    folder = LARGER if name in ALL_TYPES else SMALL
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = ordered(tuple(r) for r in df.select(*columns).collect())
    result = duck[folder].execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    theirs = ordered(tuple(r[found.index(c)] for c in columns) for r in result.fetchall())
    assert ours == theirs
