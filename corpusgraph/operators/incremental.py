"""Change classification, pruning and replace-by-file on fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.corpus import Corpus
from corpusgraph.functions.paths import is_supported

PATH_KEY = ["repo", "path"]


def classify_changes(current: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``status`` of every path: new, changed, unchanged or stale.

    Unchanged means equal mtime and size; ``force`` makes every present file new or changed.
    """
    cur = current.select(*PATH_KEY, F.col("mtime_us").alias("cur_mtime"), F.col("size").alias("cur_size"))
    old = stored.select(*PATH_KEY, F.col("mtime_us").alias("old_mtime"), F.col("size").alias("old_size"))
    same = (F.col("cur_mtime") == F.col("old_mtime")) & (F.col("cur_size") == F.col("old_size")) & F.lit(not force)
    status = (
        F.when(F.col("cur_mtime").isNull(), "stale").when(F.col("old_mtime").isNull(), "new")
        .when(same, "unchanged").otherwise("changed")
    )
    return cur.join(old, PATH_KEY, "full_outer").select(*PATH_KEY, status.alias("status"))


def stale_paths(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored paths that no longer exist."""
    return stored.select(*PATH_KEY).join(current.select(*PATH_KEY), PATH_KEY, "left_anti")


def upsert_files(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace by path: stored rows of incoming paths go, incoming rows come."""
    return stored.join(incoming.select(*PATH_KEY), PATH_KEY, "left_anti").unionByName(incoming)


def replace_facts(fact: DataFrame, replaced_files: DataFrame, incoming: DataFrame) -> DataFrame:
    """Facts of replaced (or removed) files go, incoming facts come."""
    return fact.join(replaced_files.select("file_id"), "file_id", "left_anti").unionByName(incoming)


def prune_stale(c: Corpus, stale: DataFrame) -> Corpus:
    """Remove files by (repo, path) and, by cascade, all their facts."""
    gone = c.files.join(stale.select(*PATH_KEY).distinct(), PATH_KEY, "left_semi").select("file_id")
    return Corpus(*[
        t.join(gone, "file_id", "left_anti") for t in (c.files, c.lines, c.symbols, c.imports, c.refs)
    ])


def refresh_stats(changes: DataFrame, languages: DataFrame, symbols_found: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of one refresh per repository.

    ``changes`` from :func:`classify_changes`; ``languages``: repo, path, language of the present
    files; ``symbols_found``: repo, path, n; ``errors``: repo, path, stage (``parse`` or ``write``).
    Unsupported files are counted and never parsed; files with an error are not indexed.
    """
    failed = errors.groupBy(*PATH_KEY).agg(
        F.max((F.col("stage") == "parse").cast("int")).alias("parse_error"),
        F.max((F.col("stage") == "write").cast("int")).alias("write_error"),
    )
    rows = (
        changes.join(languages.select(*PATH_KEY, "language"), PATH_KEY, "left")
        .join(symbols_found.select(*PATH_KEY, "n"), PATH_KEY, "left")
        .join(failed, PATH_KEY, "left").na.fill(0, ["parse_error", "write_error", "n"])
    )
    present = F.col("status") != "stale"
    supported = F.coalesce(is_supported("language"), F.lit(False))
    dirty = present & supported & F.col("status").isin("new", "changed")
    ok = dirty & (F.col("parse_error") == 0) & (F.col("write_error") == 0)
    return rows.groupBy("repo").agg(
        F.count_if(ok).alias("indexed"),
        F.count_if(supported & (F.col("status") == "unchanged")).alias("unchanged"),
        F.count_if(present & ~supported).alias("unsupported"),
        F.count_if(dirty & (F.col("parse_error") == 1)).alias("parse_errors"),
        F.count_if(dirty & (F.col("parse_error") == 0) & (F.col("write_error") == 1)).alias("write_errors"),
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("symbols_found"),
        F.count_if(F.col("status") == "stale").alias("stale_removed"),
    ).withColumns({
        "errors": F.col("parse_errors") + F.col("write_errors"),
        "refreshed": F.col("indexed") + F.col("stale_removed"),
    })


def latest_changes(feed: DataFrame) -> DataFrame:
    """Latest event per path by (ts, event_id): the state a change feed leads to.

    Deletes stay as tombstones. ``max_by`` combines on the map side, so a path with very many
    events sends one row per task.
    """
    return feed.groupBy(*PATH_KEY).agg(
        F.max(F.struct("ts", "event_id", "op")).alias("m"), F.count("*").alias("events")
    ).select(*PATH_KEY, "m.op", "m.event_id", "events")
