"""Fact tables on shared storage: append-only snapshots with one commit point.

Every refresh appends its facts under ``<table>/snapshot=<n>/writer=<name>`` and, last, its rows of the
files log. ``n`` is the commit order over all writers; a writer's name (a batch refresh, or one micro-batch
of one stream) keeps writers that start from the same state out of each other's folders. A file row carries a ``file_id`` that belongs to this version of the file; facts become
visible through it, so a refresh is visible as a whole or not at all, and nothing already stored
is rewritten. Deletions are rows with ``deleted = true``. A writer that is run again gets its own snapshot
again and replaces it, which makes a retried (micro-)batch idempotent. :meth:`compact` drops what is no longer visible.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.corpus import (
    FILES_SCHEMA,
    IMPORTS_SCHEMA,
    LINES_SCHEMA,
    REFS_SCHEMA,
    SYMBOLS_SCHEMA,
    Corpus,
)

LOG_SCHEMA = f"{FILES_SCHEMA}, seq BIGINT, deleted BOOLEAN"
PLACE = "snapshot BIGINT, writer STRING"
FACTS = {"lines": LINES_SCHEMA, "symbols": SYMBOLS_SCHEMA, "imports": IMPORTS_SCHEMA, "refs": REFS_SCHEMA}
# Rows of a table are gathered by repository and sorted by these columns, so min/max statistics
# skip other repositories and names. The rebalance splits a large repository over as many tasks
# and files as its size asks for and merges small ones.
LAYOUT = {"lines": "file_id", "symbols": "name", "imports": "raw_path", "refs": "name", "files": "path"}


class FactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, {PLACE}").parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # only that means nothing written yet
                raise
            return self.spark.createDataFrame([], f"{schema}, {PLACE}")

    def log(self) -> DataFrame:
        return self._read("files", LOG_SCHEMA)

    def last_snapshot(self) -> int:
        return self.log().agg(F.max("snapshot")).first()[0] or 0

    def snapshot_for(self, writer: str) -> int:
        """The snapshot this writer has committed, or the next one."""
        own = self.log().where(F.col("writer") == writer).agg(F.max("snapshot")).first()[0]
        return own or self.last_snapshot() + 1

    def latest(self, without: str | None = None) -> DataFrame:
        """Newest log row of every path, deletions included (optionally as if one writer had not run)."""
        log = self.log()
        if without is not None:
            log = log.where(F.col("writer") != without)
        names = [c for c in log.columns if c not in ("repo", "path", "snapshot", "writer")]
        newest = F.max(F.struct("snapshot", "writer", *names)).alias("m")
        return log.groupBy("repo", "path").agg(newest).select("repo", "path", "m.*")

    def _live(self) -> DataFrame:
        return self.latest().where("NOT deleted")

    def files(self) -> DataFrame:
        return self._live().drop("deleted", "seq", "writer")

    def corpus(self) -> Corpus:
        """The visible facts. File ids are per version, so one semi join per table suffices."""
        files = self.files()
        live = files.select("file_id")
        facts = {t: self._read(t, s).drop("snapshot", "writer").join(live, "file_id", "left_semi") for t, s in FACTS.items()}
        return Corpus(files=files.drop("snapshot"), **facts)

    def append(self, snapshot: int, writer: str, files: DataFrame, facts: dict[str, DataFrame]) -> None:
        """Write facts first and the files log last: the log is the commit."""
        for table, schema in FACTS.items():
            if table in facts:
                self._write(facts[table], table, schema, snapshot, writer)
        self._write(files, "files", LOG_SCHEMA, snapshot, writer)

    def _write(self, df: DataFrame, table: str, schema: str, snapshot: int, writer: str) -> None:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        (
            df.select(*names).hint("rebalance", "repo").sortWithinPartitions("repo", LAYOUT[table])
            .write.mode("overwrite").parquet(f"{self.root}/{table}/snapshot={snapshot}/writer={writer}")
        )

    def compact(self, target: FactStore) -> None:
        """Copy what is visible into an empty store as its first snapshot."""
        c = self.corpus()
        target.append(1, "compact", self._live(), {t: getattr(c, t) for t in FACTS})
