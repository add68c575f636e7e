"""Mixing sources to target weights by weighted fair queueing.

Every document of a source gets a place in a seeded shuffle. Its virtual finish time is the number of words its
source has handed out up to and with it, divided by the source's target. All documents are taken in the order
of that time until the total budget is reached, so at any cut the sources stand near their shares. A source
whose target exceeds its size is read again in the same order, up to ``repeats`` times in all.

Targets: the sources, in order of their code points with null last, have the weights ``weights`` in turn and
share ``budget`` times all words; a target stops at ``repeats`` times its source's words, and what it leaves is
shared by weight again until none is above.

Running sums never sort a whole source in one task: a source is cut into blocks of the shuffle's hash, blocks
are summed first, and only the rows of one block are ordered together. The global cut works alike on blocks of
virtual time. Blocks hold about ``block_rows`` rows at every size of input; what is ordered in one place is the
sources and the blocks of one source.

Defined results: a null text has no words; documents without words are never taken; null is a source of its own,
the last; the shuffle is seeded with all columns that can be hashed, so rows without an id or with a
repeated one have places of their own and only equal rows tie; an empty table gives an empty mix; other columns pass
through under any name (one named ``mix`` gives way to the result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from corpusgraph.runtime import materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
SEED = 17
BLOCK_ROWS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS
) -> DataFrame:
    """(source, source_size) with its ``target``. Sharing out again what capped sources leave ends where every
    source below its cap gets the same number of words per unit of weight. Sources fill up in the order of
    cap / weight, so that level follows from sums over the sources that are full before."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(
        F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)
    )
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        # The level if this source and all behind it stay below their caps; the first for which that is so is right.
        .withColumn("level", left / F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    open_from = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level")))
    rows = rows.withColumn("open_from", open_from.over(everything))
    full = F.col("open_from").isNull() | (F.col("place") < F.col("open_from.place"))
    target = F.when(full, F.col("cap")).otherwise(F.col("open_from.level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _hashable(kind: T.DataType) -> bool:
    """Whether values of the type can be hashed and ordered: no maps, variants or intervals, at any depth."""
    return not any(w in kind.simpleString() for w in ("map<", "variant", "interval", "void"))


def mix_sources(
    documents: DataFrame, size: str = "size", source: str = "source", order: tuple[str, ...] = ("doc_id",),
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The documents with a struct column ``mix``: ``source_size``, ``target`` (of the source), ``taken`` (words
    the mix takes of the document, repeats counted) and ``finish`` (virtual finish time of the first reading).
    ``size`` names a column with the document's words, ``order`` the columns that the shuffle is seeded with first, before the others."""
    documents = documents.drop("mix")
    names = documents.columns
    # The documents travel as one struct, so that no name of theirs meets an inner one. The shuffle is seeded with all
    # columns that can be hashed: rows without an id spread, and only equal rows tie.
    telling = [*order, *[f.name for f in documents.schema.fields if f.name not in order and _hashable(f.dataType)]]
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in telling]), 2)
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    # Never null, so that the join and the window below are dealt out alike and rows travel once.
    named = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    rows = documents.select(row, named.alias("__source"), F.col(f"`{size}`").alias("__size"), key.alias("__key"))
    n_rows = rows.count()
    n_blocks = max(1, -(-n_rows // block_rows))
    rows = rows.withColumn("__block", F.floor(F.col("__key") / F.lit(float(1 << 62)) * n_blocks))

    blocks = materialise(rows.groupBy("__source", "__block").agg(F.sum("__size").alias("words")), "mix-blocks")
    real = F.when(F.col("__source") != "", F.expr("substring(__source, 2)"))
    sizes = blocks.groupBy("__source").agg(F.sum("words").alias("source_size")).select(real.alias("source"), "source_size")
    targets = materialise(source_targets(sizes, weights, budget, repeats), "mix-targets")
    by_source = targets.withColumnRenamed("source", "t_source")
    before = W.partitionBy("__source").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("__b_start", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn(
        "source", real
    ).join(by_source, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "__source", "__block", "__b_start", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
    )

    within = W.partitionBy("__source", "__block").orderBy("__key", *[F.col("row").getField(c) for c in telling]).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    handed = F.col("__b_start") + F.sum("__size").over(within)
    rows = rows.join(starts, ["__source", "__block"]).withColumn("__handed", handed)
    queue = materialise(
        rows.select("row", "__size", "__key", "__handed", "__source_size", "__target"), "mix-queue"
    )

    last = cut(queue, float(targets.agg(F.sum("target")).first()[0] or 0.0), repeats, n_blocks)
    end = F.struct(F.lit(last[0]), F.lit(last[1]).cast("long"), F.lit(last[2]))
    taken = F.lit(0)
    for reading in range(repeats):
        taken = taken + F.when(_stamp(reading) <= end, F.col("__size")).otherwise(0)
    mix = F.struct(
        F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        taken.cast("long").alias("taken"), _finish(0).alias("finish"),
    )
    return queue.select(*[F.col("row").getField(c).alias(c) for c in names], mix.alias("mix"))


def _finish(reading: int) -> Column:
    """Virtual finish time of a reading of the document; sources without words have none and stay last."""
    handed = F.col("__handed") + F.lit(reading) * F.col("__source_size")
    return F.when(F.col("__target") > 0, handed / F.col("__target")).otherwise(F.lit(float(1 << 40)))


def _stamp(reading: int) -> Column:
    """Place in the global order: time, then the shuffle's hash."""
    return F.struct(_finish(reading).alias("finish"), F.col("__key").alias("key"), F.lit(reading).alias("reading"))


def cut(queue: DataFrame, total: float, repeats: int, n_blocks: int) -> tuple[float, int, int]:
    """Stamp of the last reading that still fits into ``total`` words. Readings are summed by narrow ranges of
    virtual time; only the range in which the budget runs out is put in order."""
    readings = queue.filter(F.col("__size") > 0).select(
        "__size", F.explode(F.array(*[_stamp(r) for r in range(repeats)])).alias("stamp")
    ).withColumn("range", F.floor(F.col("stamp.finish") * n_blocks))
    ranges = readings.groupBy("range").agg(F.sum("__size").alias("words"))
    filled = F.sum("words").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow))
    full = ranges.filter(F.col("range") <= 2 * n_blocks).select("range", "words", filled.alias("filled"))
    edge = full.filter(F.col("filled") > total).agg(F.min(F.struct("range", (F.col("filled") - F.col("words")).alias("start")))).first()[0]
    if edge is None:  # everything up to time 2 fits; targets are met at time 1
        return (2.0, 0, 0)
    running = F.lit(edge["start"]) + F.sum("__size").over(
        W.orderBy("stamp").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    fits = readings.filter(F.col("range") == edge["range"]).select("stamp", running.alias("running"))
    last = fits.filter(F.col("running") <= total).agg(F.max("stamp")).first()[0]
    return tuple(last) if last else (edge["range"] / n_blocks, -1, -1)
