"""Top-k per group and the relevance order of symbols."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from corpusgraph.constants import KIND_PRIORITY
from corpusgraph.functions.paths import depth_of
from corpusgraph.runtime import materialise


#: Parts of a key that are ranked apart when many rows of it are wanted.
PARTS = 64


def top_k(df: DataFrame, keys: list[str], order: list, k: int | None, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key in a total order, with their 1-based ``rank``. None: all rows, without a rank, so that no
    key has to be ordered as a whole.

    For a small ``k``, ``row_number() <= k`` is planned with a group limit in front of the shuffle: every map task
    sends at most ``k`` rows per key, so a hot key never lands whole in one task. Spark leaves that limit out above
    ``spark.sql.optimizer.windowGroupLimitThreshold``; then a first window over parts of each key keeps the first
    ``k`` of each part, and the second sees no more than those.
    """
    if k is None:
        return df.withColumn(rank, F.lit(None).cast("int"))
    w = Window.partitionBy(*keys).orderBy(*order)
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > threshold:
        rows = [c for c in df.columns if not isinstance(df.schema[c].dataType, MapType)]
        part = F.pmod(F.xxhash64(*rows), F.lit(PARTS))
        own = Window.partitionBy(*keys, "__part").orderBy(*order)
        df = df.withColumn("__part", part).withColumn("__place", F.row_number().over(own)).where(
            F.col("__place") <= k).drop("__part", "__place")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def with_rank(df: DataFrame, keys: list[str], order: list, upto: int, rank: str) -> DataFrame:
    """All rows, the first ``upto`` of each key with their place in a total order, the others without one. Parts of a key
    are ordered apart and only their first rows together, so a hot key never lies whole in one task."""
    own = Window.partitionBy(*keys, "__part").orderBy(*order)
    parted = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS))).withColumn("__place", F.row_number().over(own))
    parted = materialise(parted.drop("__part"), "parts_ranked")
    first = parted.where(F.col("__place") <= upto)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = first.withColumn(rank, F.when(place <= upto, place))
    rest = parted.where(F.col("__place") > upto).withColumn(rank, F.lit(None).cast("int"))
    return first.unionByName(rest).drop("__place")


def kind_rank(kind: str = "kind") -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(KIND_PRIORITY.items())])
    return F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(0))


def relevance_order() -> list[Column]:
    """Shallow paths first, then kind, then short paths; ties by place, so the order is total."""
    return [
        depth_of("rel_path"), kind_rank(), F.length("rel_path"),
        F.col("rel_path"), F.col("start_line"), F.col("symbol_id"),
    ]


def rank_symbols(candidates: DataFrame, limit: int | None) -> DataFrame:
    """Best symbols per (repo, target) in relevance order."""
    return top_k(candidates, ["repo", "target"], relevance_order(), limit)
