"""Diffs scoped to symbols, from a table of patch texts or from two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.corpus import Corpus
from corpusgraph.functions.text import hunk_range
from corpusgraph.operators.edges import binned_points, binned_ranges

FILE_HEADER = r"^(diff --git |index |--- |\+\+\+ )"


def patch_lines(patches: DataFrame) -> DataFrame:
    """One row per patch line: is it a file header, and the running hunk number (0 before the
    first). The window runs inside one patch, which is one stored value."""
    lines = patches.select(
        "repo", "file_id", F.posexplode(F.split("patch", "\n", -1)).alias("pos", "text"),
        F.size(F.split("patch", "\n", -1)).alias("n"),
    ).where("NOT (pos + 1 = n AND text = '')")
    w = Window.partitionBy("file_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.startswith("text", F.lit("@@"))
    return lines.select(
        "repo", "file_id", "pos", "text",
        F.regexp_like("text", F.lit(FILE_HEADER)).alias("is_header"),
        F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("int").alias("hunk_no"),
    )


def parse_hunks(lines: DataFrame) -> DataFrame:
    """Hunks of a patch with the line range they cover on the new side."""
    lo, hi = hunk_range("text")
    return lines.where(F.startswith("text", F.lit("@@"))).select(
        "repo", "file_id", "hunk_no", F.col("text").alias("header"), lo.alias("new_start"), hi.alias("new_end")
    ).where("new_start > 0")


def diff_overlap(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, hunk) pairs whose line ranges overlap in the same file, met by line bins."""
    h = binned_ranges(hunks.select("file_id", "hunk_no", "new_start", "new_end"), "new_start", "new_end")
    s = binned_ranges(symbols.select("repo", "file_id", "symbol_id", "name", "start_line", "end_line"))
    return (
        s.join(h, ["file_id", "bin"])
        .where("new_start <= end_line AND new_end >= start_line")
        .drop("bin").distinct()
    )


def symbol_diff(patches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol the file headers and only the hunks that overlap its current range."""
    lines = patch_lines(patches)
    ordered = lambda: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n"
    )
    headers = lines.where("is_header").groupBy("file_id").agg(ordered().alias("header"))
    bodies = lines.where("hunk_no > 0 AND NOT is_header").groupBy("file_id", "hunk_no").agg(ordered().alias("body"))
    return (
        diff_overlap(parse_hunks(lines), symbols)
        .join(bodies, ["file_id", "hunk_no"]).join(headers, "file_id")
        .groupBy("repo", "file_id", "symbol_id", "name")
        .agg(
            F.count("*").alias("hunks"), F.first("header").alias("header"),
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("hunk_no", "body"))), lambda x: x["body"]), "\n"
            ).alias("body"),
        )
        .select("repo", "file_id", "symbol_id", "name", "hunks", F.concat_ws("\n", "header", "body").alias("diff"))
    )


def diff_stat(patches: DataFrame) -> DataFrame:
    """Added and removed lines per patched file, headers not counted."""
    body = patch_lines(patches).where("NOT is_header AND hunk_no > 0")
    return body.groupBy("repo", "file_id").agg(
        F.count_if(F.startswith("text", F.lit("+"))).alias("added"),
        F.count_if(F.startswith("text", F.lit("-"))).alias("removed"),
    )


def symbol_bodies(c: Corpus) -> DataFrame:
    """Symbols with the SHA-256 of their source lines."""
    return (
        binned_ranges(c.symbols.select("repo", "file_id", "symbol_id", "kind", "parent", "name", "start_line", "end_line"))
        .join(binned_points(c.lines.select("file_id", "line", "text")), ["file_id", "bin"])
        .where("line BETWEEN start_line AND end_line")
        .groupBy("repo", "file_id", "symbol_id", "kind", "parent", "name", "start_line")
        .agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("body"))
        .withColumn("body_hash", F.sha2(F.array_join("body.text", "\n"), 256)).drop("body")
        .join(c.files.select("file_id", "rel_path"), "file_id")
    )


def changed_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and changed definitions between two snapshots.

    Both sides: repo, rel_path, kind, parent, name, start_line, body_hash. Identity leaves the
    line out; several definitions of one identity in a file compare as the list of their bodies
    in line order.
    """
    key = ["repo", "rel_path", "kind", "parent", "name"]

    def side(df: DataFrame, name: str) -> DataFrame:
        bodies = F.sort_array(F.collect_list(F.struct("start_line", "body_hash")))
        return df.groupBy(*key).agg(F.array_join(F.transform(bodies, lambda x: x["body_hash"]), ",").alias(name))

    status = (
        F.when(F.col("old_body").isNull(), "added").when(F.col("new_body").isNull(), "removed")
        .when(F.col("old_body") != F.col("new_body"), "changed")
    )
    return (
        side(old, "old_body").join(side(new, "new_body"), key, "full_outer")
        .select(*key, status.alias("status")).where("status IS NOT NULL")
    )
