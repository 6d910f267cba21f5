"""Types as rows, and the union that needs no order.

A node table has one row per type at a place: ``path, parent_path, tag, name,
optional, pos, at, parent_at``.  Places: ``$`` the type itself, then ``.name`` for a property,
``[]`` for array and ``<>`` for set elements, ``{k}`` and ``{v}`` for map keys
and values.  Members of a union are rows at one place, numbered by ``pos``; ``at`` lists the
numbers from the root down, so that a row knows which of several parents is its own.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from shapelog.functions.typetext import IDENTIFIER
from shapelog.session import durable, ship_package

_BARE = re.compile(IDENTIFIER).fullmatch

_NODE = (
    "path string, parent_path string, tag string, name string, optional boolean, pos int, at string, parent_at string"
)
# Types whose parts have no names, with the marks of their places.
_PARTS = {"array": ("[]",), "set": ("<>",), "map": ("{k}", "{v}")}


def _shown(label) -> str:
    """A name as types print it: bare, as a number, or quoted."""
    if not isinstance(label, str):
        return json.dumps(label)
    return label if _BARE(label) else '"' + label.replace('"', '\\"') + '"'


def _nodes_of(state: str):
    """The rows of one type, by an explicit stack: any depth that its text could be read at."""
    places = [("$", None, None, False, None, json.loads(state))]
    while places:
        path, parent, name, optional, above, t = places.pop()
        members = t[1:] if isinstance(t, list) and t[0] == "union" else [t]
        for pos, member in enumerate(members):
            at = str(pos) if above is None else f"{above}.{pos}"
            tag = member[0] if isinstance(member, list) else member
            yield path, parent, tag, name, optional, pos, at, above
            if tag == "object" and isinstance(member, list):
                for label, inner, may_lack in zip(member[1::3], member[2::3], member[3::3]):
                    shown = _shown(label)
                    places.append((f"{path}.{shown}", path, shown, bool(may_lack), at, inner))
            elif isinstance(member, list):
                for mark, inner in zip(_PARTS.get(tag, ()), member[1:]):
                    places.append((path + mark, path, None, False, at, inner))


def with_nodes(types: DataFrame, col="type_state") -> DataFrame:
    """``types`` with the array ``nodes`` of each type's rows in place of ``col``; null types go.

    One narrow step for types of any depth. A type is read once, so this belongs before
    a join that repeats it; ``F.inline`` makes rows of the arrays after it.
    """
    ship_package(types.sparkSession)
    others = [c for c in types.columns if c != col]
    row = StructType.fromDDL(_NODE)
    schema = StructType([*(types.schema[c] for c in others), StructField("nodes", ArrayType(row))])
    kinds = [f.type for f in to_arrow_schema(row)]

    def run(batches):
        for batch in batches:
            lists, ends = [], [0]
            for state in batch.column(col).to_pylist():
                lists.extend(_nodes_of(state))
                ends.append(len(lists))
            columns = zip(*lists) if lists else [[] for _ in kinds]
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds)]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, row.names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), nodes], [*others, "nodes"])

    return types.filter(F.col(col).isNotNull()).select(*others, col).mapInArrow(run, schema)


def type_nodes(types: DataFrame, col="type_state") -> DataFrame:
    """One row per type at a place, next to the other columns of ``types``."""
    others = [c for c in types.columns if c != col]
    return with_nodes(types, col).select(*others, F.inline("nodes"))


def mergeable(names_a: Column, names_b: Column) -> Column:
    """May two objects, given as arrays of distinct property names, be one?

    Yes if one has all names of the other, or if more than half of the larger
    one's names are shared.
    """
    shared = F.size(F.array_intersect(names_a, names_b))
    smaller = F.least(F.size(names_a), F.size(names_b))
    larger = F.greatest(F.size(names_a), F.size(names_b))
    return (shared == smaller) | (2 * shared > larger)


def mergeable_shapes(pairs: DataFrame, a="names_a", b="names_b") -> DataFrame:
    """Add ``mergeable`` to rows that hold two shapes each."""
    return pairs.withColumn("mergeable", mergeable(F.col(a), F.col(b)))


def mergeable_pairs(shapes: DataFrame, keys, names: str = "names") -> DataFrame:
    """All pairs of different shapes of a group that may be one: ``keys``, ``names_a``, ``names_b``.

    A set-similarity join over an inverted index of names, with no pair of shapes that
    share no name of a prefix. Each shape (an array of property names) counts once per
    group, names sorted; a is the smaller one, by size and then by text. If a has at most
    half as many names as b it must lie in b, otherwise the two share more than half of
    b's; so one of a's rarest names, all but half of them, is in b. Only these names of a
    look up the index, of shapes that are not smaller; what they meet is checked exactly.
    An empty shape may be any other one of its group.
    """
    tidy = shapes.select(*keys, F.array_sort(F.array_distinct(names)).alias("names")).distinct()
    tidy = tidy.withColumns({"size": F.size("names"), "text": F.to_json(F.struct("names"))})
    # Every shape has the name NULL stands for, the only one of an empty shape.
    held = durable(tidy.withColumn("name", F.explode(F.concat(F.array(F.lit(None).cast("string")), "names"))))
    counts = held.where("name IS NOT NULL").groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("shapes"))
    listed = held.where("name IS NOT NULL").join(counts, [*keys, "name"]).groupBy(*keys, "text").agg(
        F.array_sort(F.collect_list(F.struct("shapes", "name"))).alias("rarest"), F.first("names").alias("names"), F.first("size").alias("size")
    )
    probes = listed.select(*keys, "text", "names", "size", F.explode(F.expr("slice(rarest.name, 1, size - size div 2)")).alias("name"))
    index = held.where("name IS NOT NULL").select(
        *keys, "name", F.col("text").alias("text_b"), F.col("names").alias("names_b"), F.col("size").alias("size_b")
    )
    met = probes.join(index, [*keys, "name"])
    of_empty = held.where("size = 0").select(*keys, "text", "names", "size").join(
        index.drop("name").distinct(), keys
    )
    later = F.struct("size", "text") < F.struct("size_b", "text_b")
    columns = [*keys, F.col("names").alias("names_a"), "names_b"]
    found = met.where(later & mergeable(F.col("names"), F.col("names_b"))).select(*columns).distinct()
    return found.unionByName(of_empty.select(*columns))


def merge_nodes(nodes: DataFrame, keys) -> DataFrame:
    """Union that always merges objects, as a set operation over places.

    Per ``keys`` and place: the tags found there, and whether it is optional,
    because it is so somewhere or because a parent object lacks it.  Counts,
    maxima and sets of tags combine in any order, so the aggregate is partial
    before the shuffle and a hot key costs no more than a rare one.  Places are
    looked up by their children, so they are written once.  The answer is wider than the ordered ``union_types``, which keeps unlike objects apart.
    """
    places = durable(
        nodes.groupBy(*keys, "path", "parent_path", "name").agg(
            F.collect_set("tag").alias("tags"),
            F.max("optional").alias("stated_optional"),
            F.count(F.when(F.col("pos") == 0, 1)).alias("present"),
            F.count(F.when(F.col("tag") == "object", 1)).alias("objects"),
        )
    )
    parents = places.filter("objects > 0").select(
        *keys, F.col("path").alias("parent_path"), F.col("objects").alias("parent_objects")
    )
    missing = F.coalesce(F.col("present") < F.col("parent_objects"), F.lit(False))
    return places.join(parents, [*keys, "parent_path"], "left").select(
        *keys, "path", "parent_path", "name",
        F.array_sort("tags").alias("tags"),
        (F.col("stated_optional") | (F.col("name").isNotNull() & missing)).alias("optional"),
        "present",
    )


def merged_types(merged: DataFrame, keys) -> DataFrame:
    """Rows of ``merge_nodes`` as one type text per ``keys``: ``type_ts``.

    Texts are put together from the innermost places outwards; a row holds the
    parts of one place, so it is as large as the type it prints.  The deepest
    place tells the number of steps, so ``merged`` is written once and read.
    """
    level = F.size(F.split(F.regexp_replace("path", r'"(?:[^"\\]|\\.)*"', "q"), r"[.]|\[\]|<>|\{[kv]\}"))
    places = durable(merged.withColumn("level", level))
    inner = None
    for n in range(places.agg(F.max("level")).first()[0] or 1, 0, -1):
        here = places.filter(F.col("level") == n)
        if inner is None:
            here = here.withColumn("parts", F.lit(None).cast("array<struct<place:string,name:string,text:string>>"))
        else:
            here = here.join(inner, [*keys, "path"], "left")
        texts = here.withColumn("text", _place_text())
        if n == 1:
            return texts.select(*keys, F.col("text").alias("type_ts"))
        place = F.expr("substring(path, length(parent_path) + 1)")
        part = F.struct(
            place.alias("place"),
            "name",
            F.concat(
                F.coalesce("name", F.lit("")),
                F.when(F.col("optional"), "?").otherwise(""),
                F.when(F.col("name").isNotNull(), ": ").otherwise(""),
                "text",
            ).alias("text"),
        )
        inner = texts.groupBy(*keys, F.col("parent_path").alias("path")).agg(
            F.collect_list(part).alias("parts")
        )


def _place_text() -> Column:
    def texts_at(suffix):
        found = F.filter(F.coalesce("parts", F.array()), lambda part: part["place"] == suffix)
        return F.transform(found, lambda part: part["text"])

    # Names in name order: texts before integers, each by value.
    is_int = lambda part: part["name"].rlike(r"^-?\d+$")
    named = F.array_sort(
        F.transform(
            F.filter(F.coalesce("parts", F.array()), lambda part: part["name"].isNotNull()),
            lambda part: F.struct(
                is_int(part).alias("is_int"),
                F.when(is_int(part), part["name"].cast("bigint")).alias("number"),
                F.replace(
                    F.regexp_replace(part["name"], r'^"|"$', ""), F.lit('\\"'), F.lit('"')
                ).alias("name"),
                part["text"].alias("text"),
            ),
        )
    )
    properties = F.array_join(F.transform(named, lambda part: part["text"]), "; ")

    def wrapped(word, *suffixes):
        inner = [texts_at(suffix) for suffix in suffixes]
        return F.concat(F.lit(f"{word}<"), F.array_join(F.concat(*inner), ", "), F.lit(">"))

    text_of = {
        "object": F.concat(F.lit("{"), properties, F.lit("}")),
        "array": wrapped("Array", "[]"),
        "set": wrapped("Set", "<>"),
        "map": wrapped("Map", "{k}", "{v}"),
    }

    def member(tag):
        return reduce(
            lambda chain, item: chain.when(tag == item[0], item[1]),
            list(text_of.items())[1:],
            F.when(tag == "object", text_of["object"]),
        ).otherwise(tag)

    tags = F.filter("tags", lambda tag: (tag != "never") | (F.size("tags") == 1))
    joined = F.array_join(F.array_sort(F.transform(tags, member)), " | ")
    return F.when(F.array_contains("tags", "any"), "any").otherwise(joined)
