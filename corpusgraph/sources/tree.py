"""Scanning source trees into file, content and line tables.

Spark's own file sources never list names that start with ``.`` or ``_``, which would lose rule
files and every ``__init__.py``; listing and reading therefore run as small functions inside
tasks. Folders are listed level by level, so a huge repository spreads over tasks, skipped
folders are never entered, and only files that are asked for are opened.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.constants import SKIP_DIRECTORIES
from corpusgraph.functions.paths import base_name, detect_language, is_supported
from corpusgraph.runtime import is_empty, materialise

ENTRY_SCHEMA = "path STRING, rel_path STRING, is_dir BOOLEAN, mtime_us BIGINT, size BIGINT, failed BOOLEAN"
# Names that Spark has for a store, and the one that the file system library knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs", "hdfs": "hdfs", "s3": "s3"}
CONTENT_SCHEMA = "repo STRING, path STRING, content BINARY, error STRING"
READ_CHUNK_BYTES = 32 << 20


def _known(path: str) -> str:
    """The path under the scheme that the file system library knows."""
    scheme, rest = path.split("://", 1)
    return f"{SCHEMES[scheme]}://{rest}"


def _list_folder(path: str) -> list[tuple[str, str, bool, int, int]]:
    """(path, name, is_dir, mtime_us, size) of a folder's entries; links are never followed."""
    if "://" not in path:
        with os.scandir(path) as entries:
            stats = [(e, e.stat(follow_symlinks=False)) for e in entries]
        return [(e.path, e.name, e.is_dir(follow_symlinks=False), s.st_mtime_ns // 1000, s.st_size) for e, s in stats]
    from pyarrow import fs

    scheme = path.split("://", 1)[0]
    system, inner = fs.FileSystem.from_uri(_known(path))
    infos = system.get_file_info(fs.FileSelector(inner))
    return [
        (f"{scheme}://{i.path}", i.base_name, i.type == fs.FileType.Directory, (i.mtime_ns or 0) // 1000, i.size or 0)
        for i in infos
    ]


def _read_file(path: str) -> bytes:
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(_known(path))
    with system.open_input_stream(inner) as f:
        return f.read()


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "rel_path", "is_dir", "mtime_us", "size", "failed"]
    for batch in batches:
        for folder, rel in zip(batch["path"], batch["rel_path"]):
            try:
                entries = _list_folder(folder)
            except OSError:  # named, so that nobody takes what lies below for deleted
                yield pd.DataFrame([(folder, rel, False, 0, 0, True)], columns=columns)
                continue
            yield pd.DataFrame(
                [(p, f"{rel}/{name}" if rel else name, d, m, s, False) for p, name, d, m, s in entries], columns=columns
            )


def _read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["repo", "path", "content", "error"]
    rows, held = [], 0
    for batch in batches:
        for repo, path in zip(batch["repo"], batch["path"]):
            try:
                content, error = _read_file(path), None
            except OSError as e:
                content, error = None, str(e)
            rows.append((repo, path, content, error))
            held += len(content or b"")
            if held >= READ_CHUNK_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def list_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Every file below ``root`` outside skipped and hidden folders: repo, path, rel_path,
    language, mtime_us, size. Hidden *files* are listed. Folders that cannot be listed are rows
    with ``failed`` and no language."""
    scheme = root.split("://", 1)[0] if "://" in root else "file"
    if scheme != "file" and scheme not in SCHEMES:
        raise ValueError(f"cannot list {scheme}:// trees; known are file, {', '.join(SCHEMES)}")
    plain = root.removeprefix("file://").rstrip("/")
    folders = spark.createDataFrame([(plain, "")], "path string, rel_path string")
    cores = spark.sparkContext.defaultParallelism
    levels = []
    while True:
        level = materialise(folders.mapInPandas(_list_folders, ENTRY_SCHEMA), "tree_level")
        levels.append(level.where("NOT is_dir"))
        name = base_name("rel_path")
        folders = (
            level.where(F.col("is_dir") & ~name.isin(*SKIP_DIRECTORIES) & ~F.startswith(name, F.lit(".")))
            .select("path", "rel_path").repartition(cores)
        )
        if is_empty(folders):
            break
    below = F.col("rel_path")
    if repo is None:
        repo_col, rel = F.substring_index(below, "/", 1), F.regexp_replace(below, "^[^/]*/", "")
    else:
        repo_col, rel = F.lit(repo), below
    return reduce(DataFrame.unionByName, levels).select(
        repo_col.alias("repo"), "path", rel.alias("rel_path"), 
        F.when(F.col("failed"), "").otherwise(detect_language(rel)).alias("language"), "mtime_us", "size", "failed",
    )


def scan_source_tree(spark: SparkSession, root: str, repo: str | None = None, supported_only: bool = True) -> DataFrame:
    """Source files below ``root``; no content is read.

    ``repo`` names one repository at ``root``; without it the first folder below ``root`` is the
    repository. Files without a known language drop out, and by default those the extraction
    does not support. Ignore rules are a step of their own, see :mod:`corpusgraph.sources.ignore`.
    """
    files = list_tree(spark, root, repo).where("language <> ''").drop("failed")
    return files.where(is_supported("language")) if supported_only else files


def read_files(files: DataFrame) -> DataFrame:
    """(repo, path, content, error) of the given files; a file that cannot be read has an error
    and no content, and never fails the job."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.select("repo", "path").repartition(cores, "path").mapInPandas(_read_files, CONTENT_SCHEMA)


def read_contents(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """Supported files with ``content`` (text) and ``hash`` (SHA-256 of the bytes)."""
    files = scan_source_tree(spark, root, repo)
    read = read_files(files).where("error IS NULL").select("repo", "path", "content")
    return with_hash(files.join(read, ["repo", "path"])).withColumn("content", decode_text("content"))


def decode_text(content: str) -> Column:
    """Bytes read as UTF-8; odd bytes never fail the job."""
    return F.col(content).cast("string")


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("hash", F.sha2(F.col(content), 256))


def n_lines(content: str) -> Column:
    """How many lines :func:`explode_lines` makes of a text; none of a null."""
    parts = F.split(content, "\n", -1)
    return F.when(F.col(content).isNull(), 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def explode_lines(contents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """1-based line table of (repo, file_id, content), with the columns ``keep`` of the file.

    A carriage return at a line end is removed, the empty rest behind a final newline is no
    line, and lines have no length limit.
    """
    keep = keep or []
    parts = F.split("content", "\n", -1)
    text = F.when(F.right("raw", F.lit(1)) == "\r", F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))
    return (
        contents.select("repo", "file_id", *keep, F.size(parts).alias("n"), F.posexplode(parts).alias("pos", "raw"))
        .where("NOT (pos + 1 = n AND raw = '')")
        .select("repo", "file_id", (F.col("pos") + 1).alias("line"), text.alias("text"), *keep)
    )
