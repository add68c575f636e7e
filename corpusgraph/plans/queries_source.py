"""Registered queries over derived source code: extraction, batch refresh, stream refresh."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.extraction import extract
from corpusgraph.plans import fixtures as fx
from corpusgraph.plans.registry import query
from corpusgraph.runtime import shared, work_dir
from corpusgraph.sources.store import FactStore
from corpusgraph.streaming import refresh as rf


def masked_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "source_lines", lambda: extract.masked_lines(fx.sources(spark, sf)))


_COLUMNS = ["repo", "file_id", "language", "name", "kind", "start_line", "end_line", "parent", "depth", "signature"]


@query("extract_symbols", "SELECT repo, file_id, language, name, kind, start_line, end_line, parent, depth, signature FROM fx_src_symbols")
def extract_symbols(spark, sf):
    return extract.symbols_of(masked_lines(spark, sf)).select(_COLUMNS)


@query(
    "block_ends",
    "SELECT file_id, CAST(start_line AS INT) AS line, CAST(end_line AS INT) AS end_line FROM fx_src_symbols",
)
def block_ends(spark, sf):
    lines = masked_lines(spark, sf)
    return extract.ends_of(lines, extract.written_definitions(lines)).select("file_id", "line", "end_line")


@query(
    "extract_imports",
    """SELECT repo, file_id, CASE language WHEN 'python' THEN 'import mod_' || line WHEN 'go' THEN 'mod/' || line
       WHEN 'javascript' THEN 'mod_' || line ELSE 'import mod.l' || line || ';' END AS raw_path, language FROM fx_parts WHERE w IS NULL""",
)
def extract_imports(spark, sf):
    return extract.imports_of(masked_lines(spark, sf))


@query(
    "extract_refs",
    """SELECT repo, file_id, CASE language WHEN 'python' THEN s + 2 ELSE s + 1 END AS line, c AS name, language FROM fx_parts
       WHERE w IS NOT NULL AND NOT (language = 'go' AND is_class) AND NOT (language = 'java' AND NOT is_class)""",
)
def extract_refs(spark, sf):
    return extract.refs_of(masked_lines(spark, sf)).drop("ord")


def _fresh_store(spark: SparkSession, name: str) -> FactStore:
    return FactStore(spark, f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")


_AFTER = """SELECT p.repo, p.path, coalesce(s.n, 0) AS symbols FROM ({live}) p
    LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_src_symbols GROUP BY file_id) s ON s.file_id = p.file_id"""


@query(
    "refresh",
    _AFTER.format(live="SELECT f.repo, f.path, f.file_id FROM fx_files f LEFT JOIN labels l ON l.doc_id = f.file_id "
                       "WHERE coalesce(l.toxic, 0) = 0 AND EXISTS (SELECT 1 FROM fx_lines x WHERE x.file_id = f.file_id)"),
)
def refresh(spark, sf):
    """Two snapshots into a new store: first the labelled documents, then the unlabelled ones
    come, the low-quality ones change and the toxic ones go. Symbols per visible file."""
    store = _fresh_store(spark, "store")
    labels = fx.read(spark, sf, "labels")
    sources = fx.sources(spark, sf).withColumn("size", F.octet_length("content").cast("bigint"))
    marked = sources.join(labels, F.col("file_id") == F.col("doc_id"), "left").drop("file_id")
    columns = ["repo", "path", "rel_path", "language", "mtime_us", "size", "content"]
    rf.apply_changes(store, 1, marked.where("quality IS NOT NULL").select(columns), marked.where("false").select("repo", "path"))
    again = marked.where("quality IS NULL OR (quality = 0 AND toxic = 0)")
    rf.apply_changes(store, 2, again.select(columns), marked.where("toxic = 1").select("repo", "path"))
    return _symbols_per_file(store)


def _symbols_per_file(store: FactStore) -> DataFrame:
    c = store.corpus()
    counts = c.symbols.groupBy("file_id").agg(F.count("*").alias("symbols"))
    return c.files.select("repo", "path", "file_id").join(counts, "file_id", "left").na.fill(0, ["symbols"]).drop("file_id")


@query(
    "refresh_stream",
    """
    , latest AS (SELECT user_id, arg_max(event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(event_id::VARCHAR, 12, '0')) AS t FROM events GROUP BY user_id)
    """ + _AFTER.format(live="SELECT 'events' AS repo, '/repo/u' || l.user_id AS path, p.file_id FROM latest l "
                             "JOIN (SELECT DISTINCT file_id FROM fx_lines) p ON p.file_id = l.user_id WHERE l.t <> 'error'"),
)
def refresh_stream(spark, sf):
    """The events table as a change feed: each upsert carries the source of the user's document,
    ``error`` events delete. Symbols per path that is left when the stream has run."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    content = fx.sources(spark, sf).select(F.col("file_id").alias("user_id"), "rel_path", "language", "content")
    feed = events.join(content, "user_id").select(
        F.lit("events").alias("repo"), F.concat(F.lit("/repo/u"), "user_id").alias("path"), "rel_path", "language",
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("mtime_us"),
        F.col("event_id").alias("seq"), "content",
    )
    store = _fresh_store(spark, "stream-store")
    rf.refresh_stream(feed, store, f"{store.root}/checkpoint").awaitTermination()
    return _symbols_per_file(store)
