"""The fact tables every operator works on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

FILES_SCHEMA = (
    "repo STRING, file_id BIGINT, path STRING, rel_path STRING, language STRING, hash STRING, "
    "mtime_us BIGINT, size BIGINT, n_lines INT"
)
LINES_SCHEMA = "repo STRING, file_id BIGINT, line INT, text STRING"
SYMBOLS_SCHEMA = (
    "repo STRING, symbol_id BIGINT, file_id BIGINT, name STRING, kind STRING, start_line INT, "
    "end_line INT, start_col INT, end_col INT, parent STRING, depth INT, signature STRING, "
    "language STRING"
)
IMPORTS_SCHEMA = "repo STRING, file_id BIGINT, raw_path STRING, language STRING"
REFS_SCHEMA = "repo STRING, file_id BIGINT, line INT, ord INT, name STRING, language STRING"


@dataclass(frozen=True)
class Corpus:
    """Facts of many repositories. ``repo`` is part of every key; ``file_id`` is unique over all.

    Empty strings stand for "none" (``parent = ''`` is top level), as the model prescribes.
    """

    files: DataFrame
    lines: DataFrame
    symbols: DataFrame
    imports: DataFrame
    refs: DataFrame

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql``."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(prefix + f.name)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession


class LazyCorpus(Corpus):
    """A corpus whose tables are made when they are first read, so that a query pays for the facts it uses."""

    def __init__(self, **builders: Callable[[], DataFrame]) -> None:
        object.__setattr__(self, "_builders", builders)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        object.__setattr__(self, name, self._builders[name]())
        return getattr(self, name)


def with_files(fact: DataFrame, files: DataFrame) -> DataFrame:
    """fact joined with its file: adds ``path`` and ``rel_path`` (every lookup needs it)."""
    return fact.join(files.select("file_id", "path", "rel_path"), "file_id")
