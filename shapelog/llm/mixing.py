"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapelog.llm.common import stored, whole

#: Weights of the sources in order, repeating; words to take as a share of all words;
#: how often a source's words may be taken; words of a block.
WEIGHTS, SHARE, MOST, BLOCK = (3, 1, 2), 1.5, 2, 256
#: Hex digits of the shuffle key that cut a source into parts: at most 4,096 of them.
DIGITS = 3
#: Bits of a slot number that cut a source's slots into parts.
PARTS = 12
#: Slots that one row is exploded to.
RUN = 1 << 16


def words(column: str = "text"):
    """Number of words of a text; null has none."""
    return F.regexp_count(whole(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``n``, its place in a total order from 0, without a task that holds all rows.

    Range partitions are sorted and stored; each row's place in its partition, which
    ``monotonically_increasing_id`` holds, is shifted by the sizes of those before.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(sorted_.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    held = held.withColumn("__part", F.shiftright("__id", 33))
    before = held.groupBy("__part").agg(F.count("*").alias("__size"))
    before = before.withColumn(
        "__before", F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    )
    place = F.coalesce("__before", F.lit(0)) + F.col("__id").bitwiseAND((1 << 33) - 1)
    return held.join(before, "__part").withColumn("n", place).drop("__id", "__part", "__size", "__before")


def source_key(column: str = "source"):
    """Orders as the sources do, by code point and null last, and is never null."""
    return F.when(F.col(column).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(column)))


def targets(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(key, source_size, target, goal, ...) of each source of ``rows(key, size)``.

    The words to take are shared by weight; targets stop at ``most`` times their
    source's words, and what is over is shared among the rest by weight, again and
    again until no target is above. Each round is one aggregate of one row; the
    level rises with every round, as in Newton's method. ``goal`` is the target in
    whole words.
    """
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    listed = numbered(sizes, "key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    listed = stored(
        listed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).drop("n"), "sources"
    )
    wanted = share * (listed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") / F.col("weight") <= level
        row = listed.agg(
            F.sum(F.when(full, F.col("cap"))).alias("caps"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["weights"]:
            break
        level, capped = (wanted - (row["caps"] or 0)) / row["weights"], row["n"]
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    listed = listed.withColumn("target", target)
    return listed.withColumn("goal", F.least(F.floor(F.col("target") + 0.5), F.col("cap")))


def reversed_bits(column, bits: int):
    """The lowest ``bits`` (up to 62) bits of a number, mirrored: van der Corput's points as integers."""
    def half(v):
        for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
            v = F.shiftright(v, shift).bitwiseAND(mask).bitwiseOR(F.shiftleft(v.bitwiseAND(mask), shift))
        return v

    v = F.col(column).cast("long")
    low = half(v.bitwiseAND(0xFFFFFFFF))
    if bits <= 32:
        return F.shiftright(low, 32 - bits)
    return F.shiftrightunsigned(F.shiftleft(low, 32).bitwiseOR(half(F.shiftright(v, 32))), 64 - bits)


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, slot, rank): the order in which the sources' blocks are taken.

    The sources' slots lie side by side as a cumulative weight from 0 to their total.
    Van der Corput's sequence visits these places; as mirroring is its own inverse,
    the time ``slot`` of a place is its mirrored number, so that any stretch of slots
    holds each source in its share up to a logarithmic number of slots. ``rank``
    counts a source's slots in that order; it is a count of parts, summed up per
    source, and a place in a part, so that no task holds all slots of a source.
    """
    counted = sources.where("goal > 0").select(
        "key",
        (
            F.expr("goal div source_size") * F.ceil(F.col("source_size") / block)
            + F.ceil(F.expr("goal % source_size") / block)
        ).alias("slots"),
    )
    placed = numbered(counted, "key")
    placed = placed.withColumn("part", F.expr("n div 4096"))
    sums = placed.groupBy("part").agg(F.sum("slots").alias("held"))
    sums = sums.withColumn(
        "ahead", F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    )
    own = Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("before", F.coalesce(F.sum("slots").over(own), F.lit(0))).join(sums, "part")
    placed = stored(
        placed.select("key", "slots", (F.col("before") + F.coalesce("ahead", F.lit(0))).alias("first")), "placed"
    )
    total = placed.agg(F.sum("slots")).first()[0] or 0
    bits = max(PARTS, (max(1, total) - 1).bit_length())
    # In two steps, so that no row holds a list of all runs of a large source.
    wide = placed.select(
        "key", "slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RUN * RUN))).alias("wide")
    ).repartition("key", "wide")
    end = F.least(F.col("wide") + RUN * RUN, F.col("slots")) - 1
    runs = wide.select("key", "slots", "first", F.explode(F.sequence("wide", end, F.lit(RUN))).alias("run")).repartition("key", "run")
    places = runs.select(
        "key", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("slots")) - 1)).alias("at"), "first"
    ).select("key", (F.col("first") + F.col("at")).alias("place"))
    slots = places.select("key", reversed_bits("place", bits).alias("slot"))
    slots = slots.withColumn("part", F.shiftright("slot", bits - PARTS))
    parts = slots.groupBy("key", "part").agg(F.count("*").alias("held"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy("slot"))
    # Runs of slots compress so well that their shuffled size hides how many they are.
    return slots.withColumn("place", place).hint("merge").join(parts, ["key", "part"]).select(
        "key", "slot", (F.col("ahead") + F.col("place") - 1).alias("rank")
    )


def shuffled(rows: DataFrame) -> DataFrame:
    """``rows(key, doc_id, size, ...)`` with ``start``: the words of the source before, in shuffled order.

    Rows are ordered by a digest of doc_id, then doc_id and size. A source is cut into
    parts by the digest's first digits; the parts' sums are added up per source.
    """
    mixed = rows.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    mixed = mixed.withColumn("part", F.substring("digest", 1, DIGITS))
    parts = mixed.groupBy("key", "part").agg(F.sum("size").alias("held"))
    ahead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    own = Window.partitionBy("key", "part").orderBy("digest", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return mixed.withColumn("before", before).join(parts, ["key", "part"]).withColumn(
        "start", F.col("ahead") + F.col("before")
    ).drop("digest", "part", "ahead", "before")


def scheduled(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, keep=()):
    """The mix as a schedule of pieces, and the rows that they are cut from.

    Gives two tables. Pieces: slot, key (of the source), start (which row of the source),
    pass, first and last (the row's words from ``first`` up to but without ``last``);
    in order of slot, then start, they are the mixed corpus, and any stretch of slots
    holds each source in its share. Rows: doc_id, key, start, size, source_size, target
    and the columns of ``keep``. A source's documents are shuffled, laid end to end and
    cut into blocks of ``block`` words; its slots of the schedule take its blocks in
    turn, from the first again after the last, and the slot that is last in the
    source's order takes what is left to the target.
    """
    rows = docs.select(
        source_key().alias("key"), F.col("doc_id"), words().alias("size"), F.struct(*keep).alias("kept")
        if keep else F.lit(None).cast("string").alias("kept"),
    )
    rows = stored(rows, "sized")
    sources = stored(targets(rows, weights, share, most), "targets")
    laid = stored(shuffled(rows), "laid")
    pieces = laid.where("size > 0").select(
        "key", "start", "size",
        F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"),
    )
    slots = schedule(sources, block).hint("merge").join(sources.select("key", "source_size", "goal"), "key")
    slots = slots.withColumn("blocks", F.ceil(F.col("source_size") / block)).select(
        "key",
        "slot",
        F.expr("rank div blocks").alias("pass"),
        F.expr("rank % blocks").alias("block"),
        F.least("source_size", F.col("goal") - F.expr("rank div blocks") * F.col("source_size")).alias("stop"),
    )
    first = F.greatest("start", F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, "stop")
    cut = pieces.join(slots.hint("merge"), ["key", "block"]).where(first < last)
    cut = cut.select("slot", "key", "start", "pass", (first - F.col("start")).alias("first"), (last - F.col("start")).alias("last"))
    return cut, laid.join(sources.select("key", "source_size", "target"), "key")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, keep=()) -> DataFrame:
    """What the schedule takes of each row of ``docs(doc_id, source, text)``.

    Gives doc_id, size (words), source_size, target, taken (words, repeats counted),
    passes (for each pass of the source in which it is taken: words, and the slot of the
    first piece) and the columns named in ``keep``. All are sums over the pieces of
    ``scheduled``. A source's taken words are its target in whole words, and no row
    exceeds ``most`` times its size.

    Sources are ordered by code point, null last. Null and empty texts have size 0 and
    nothing taken; rows with equal or null ids each stay a row; other columns are not
    read. An empty table gives an empty result.
    """
    cut, laid = scheduled(docs, weights, share, most, block, keep)
    length = F.col("last") - F.col("first")
    taken = cut.groupBy("key", "start").agg(
        F.sum(length).alias("taken"),
        *[F.sum(F.when(F.col("pass") == p, length)).alias(f"words{p}") for p in range(most)],
        *[F.min(F.when(F.col("pass") == p, F.col("slot"))).alias(f"slot{p}") for p in range(most)],
    )
    each = [F.struct(F.col(f"words{p}").alias("words"), F.col(f"slot{p}").alias("slot")) for p in range(most)]
    taken = taken.select("key", "start", "taken", F.filter(F.array(*each), lambda x: x["words"].isNotNull()).alias("passes"))
    # A row without words shares its start with the next row but takes nothing.
    full = laid.where("size > 0").join(taken, ["key", "start"], "left")
    none = laid.where("size = 0").select("*", F.lit(None).cast("long").alias("taken"), F.lit(None).cast(taken.schema["passes"].dataType).alias("passes"))
    named = [F.col(f"kept.`{c}`").alias(c) for c in keep]
    return full.select(*none.columns).union(none).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "passes", *named
    )
