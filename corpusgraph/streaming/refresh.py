"""Refreshing a fact store from a source tree (batch) or from a change feed (stream)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgraph.extraction import extract
from corpusgraph.functions.paths import base_name, is_supported
from corpusgraph.operators.incremental import PATH_KEY, classify_changes, refresh_stats
from corpusgraph.runtime import is_empty, materialise
from corpusgraph.sources import ignore, tree
from corpusgraph.sources.store import FactStore


def extract_facts(contents: DataFrame) -> dict[str, DataFrame]:
    """All facts of (repo, file_id, language, content). The masked lines are written once and
    feed the three extractors."""
    lines = extract.masked_lines(contents)
    definitions = extract.written_definitions(lines)
    return {
        "lines": tree.explode_lines(contents),
        "symbols": extract.symbols_of(lines, definitions=definitions),
        "imports": extract.imports_of(lines),
        "refs": extract.refs_of(lines, definitions),
    }


def apply_changes(
    store: FactStore, snapshot: int, present: DataFrame, gone: DataFrame, writer: str = "batch"
) -> DataFrame:
    """Write one snapshot of one writer: extract ``present`` (repo, path, rel_path, language, mtime_us, size,
    content), mark ``gone`` (repo, path) as deleted; both may carry ``seq``. Returns symbols found per path."""
    version = F.xxhash64("repo", "path", F.lit(snapshot), F.lit(writer))
    seq = lambda df: F.col("seq") if "seq" in df.columns else F.lit(None).cast("bigint")
    versioned = materialise(
        present.withColumns({
            "file_id": version, "seq": seq(present),
            "hash": F.sha2("content", 256), "content": F.col("content").cast("string"),
        }), "dirty"
    )
    facts = extract_facts(versioned)
    facts = {t: materialise(df, t) if t in ("lines", "symbols") else df for t, df in facts.items()}
    n_lines = facts["lines"].groupBy("file_id").agg(F.count("*").cast("int").alias("n_lines"))
    rows = versioned.drop("content").join(n_lines, "file_id", "left").na.fill(0, ["n_lines"]).withColumn("deleted", F.lit(False))
    when = F.col("mtime_us") if "mtime_us" in gone.columns else F.lit(None).cast("bigint")
    tombstones = gone.select("repo", "path", when.alias("mtime_us"), seq(gone).alias("seq")).withColumns({
        "file_id": version, "rel_path": F.lit(""), "language": F.lit(""),
        "hash": F.lit(""), "size": F.lit(0).cast("bigint"), "n_lines": F.lit(0), "deleted": F.lit(True),
    })
    store.append(snapshot, writer, rows.unionByName(tombstones), facts)
    found = facts["symbols"].groupBy("file_id").agg(F.count("*").alias("n"))
    return versioned.select("repo", "path", "file_id").join(found, "file_id", "left").na.fill(0, ["n"]).drop("file_id")


def _ignore_rules(listed: DataFrame) -> DataFrame:
    """Rules of all listed ``.gitignore`` files."""
    rule_files = listed.where(base_name("rel_path") == ".gitignore")
    base = F.regexp_replace("rel_path", "/?[.]gitignore$", "").alias("base_dir")
    text = tree.read_files(rule_files).where("error IS NULL").select("repo", "path", tree.decode_text("content").alias("content"))
    return ignore.parse_rules(rule_files.select("repo", "path", base).join(text, PATH_KEY).select("repo", "base_dir", "content"))


def _without_unknown(changes: DataFrame, failed: DataFrame, root: str) -> DataFrame:
    """Changes without stale paths below a folder of ``failed``: the folders above a path meet the failed ones."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    stale = changes.where("status = 'stale'")
    unknown = stale.select(*PATH_KEY, F.explode(above).alias("folder")).join(
        failed.select(F.col("path").alias("folder")), "folder", "left_semi"
    ).select(*PATH_KEY).distinct()
    return changes.join(unknown, PATH_KEY, "left_anti")


def refresh(spark: SparkSession, root: str, store: FactStore, repo: str | None = None, force: bool = False) -> DataFrame:
    """Bring the store up to date with a source tree and return the counters per repository.

    Metadata (mtime and size) decides what is dirty, and only dirty files are opened. A file
    that cannot be read is counted as a parse error and leaves the others alone. Running it
    again changes nothing. A folder that cannot be listed keeps what is stored of it.
    """
    listed = tree.list_tree(spark, root, repo)
    failed = materialise(listed.where("failed"), "failed_folders")
    listed = listed.where("NOT failed").drop("failed")
    scanned = materialise(ignore.keep_visible(listed.where("language <> ''"), _ignore_rules(listed)), "scan")
    present = scanned.where(is_supported("language"))
    changes = materialise(classify_changes(present, store.files(), force), "changes")
    dirty = present.join(changes.where("status IN ('new', 'changed')").select(*PATH_KEY), PATH_KEY)
    # What lies below a folder that could not be listed is unknown, not gone.
    changes = materialise(_without_unknown(changes, failed, root), "known_changes")
    stale = changes.where("status = 'stale'")
    found = spark.createDataFrame([], "repo string, path string, n bigint")
    errors = spark.createDataFrame([], "repo string, path string, stage string")
    if not is_empty(changes.where("status <> 'unchanged'")):
        read = materialise(tree.read_files(dirty), "contents")
        contents = dirty.join(read.where("error IS NULL").select(*PATH_KEY, "content"), PATH_KEY)
        found = apply_changes(store, store.last_snapshot() + 1, contents, stale, f"batch-{uuid.uuid4().hex[:12]}")
        errors = read.where("error IS NOT NULL").select(*PATH_KEY, F.lit("parse").alias("stage"))
    unsupported = scanned.where(~is_supported("language"))
    counted = changes.unionByName(unsupported.select(*PATH_KEY, F.lit("new").alias("status")))
    return refresh_stats(counted, scanned, found, errors)


def refresh_batch(store: FactStore, feed: DataFrame, batch_id: int, stream: str = "feed") -> None:
    """Apply one micro-batch of a change feed (repo, path, rel_path, language, op, mtime_us, seq,
    content). The latest event per path wins by (mtime_us, seq), within a batch and against what is stored;
    stored rows without a seq count as older. The writer is this batch of this stream, so a replayed
    batch writes its own snapshot again, and nobody else's."""
    writer = f"{stream}-{batch_id}"
    snapshot = store.snapshot_for(writer)
    newest = F.max(F.struct("mtime_us", "seq", "op", "rel_path", "language", "content")).alias("e")
    latest = feed.groupBy(*PATH_KEY).agg(newest).select(*PATH_KEY, "e.*")
    known = store.latest(without=writer).select(
        *PATH_KEY, F.col("mtime_us").alias("known_us"), F.coalesce("seq", F.lit(-1)).alias("known_seq"))
    newer = "known_us IS NULL OR mtime_us > known_us OR (mtime_us = known_us AND seq > known_seq)"
    fresh = latest.join(known, PATH_KEY, "left").where(newer).drop("known_us", "known_seq")
    fresh = materialise(fresh, "fresh_events")
    present = fresh.where("op <> 'delete'").withColumn("size", F.octet_length("content").cast("bigint"))
    columns = ["repo", "path", "rel_path", "language", "mtime_us", "seq", "size", "content"]
    apply_changes(store, snapshot, present.select(columns), fresh.where("op = 'delete'"), writer)


def refresh_stream(feed: DataFrame, store: FactStore, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a store fresh from a streaming change feed; see :func:`refresh_batch`."""

    def apply(df: DataFrame, batch_id: int) -> None:
        # The id of the query lives in its checkpoint: a new checkpoint is another writer.
        stream = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "feed"
        refresh_batch(store, df, batch_id, stream)

    writer = feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_state_stream(feed: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming latest event per path for update-mode sinks; events later than ``delay`` behind
    the newest are dropped by the watermark. ``feed``: repo, path, op, ts, event_id."""
    return (
        feed.withWatermark("ts", delay).groupBy(*PATH_KEY)
        .agg(F.max(F.struct("ts", "event_id", "op")).alias("m"), F.count("*").alias("events"))
        .select(*PATH_KEY, "m.op", "m.event_id", "events")
    )
