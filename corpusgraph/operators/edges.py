"""Line-range joins: enclosing symbols, containment, call edges, nesting.

Ranges and points of one file meet on (file, bin of 64 lines), never on the file alone, so one
huge file spreads over many tasks. A range is copied once per bin it touches; for nested ranges
that is at most nesting depth * lines / 64 copies plus one per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.constants import TRACE_MIN_NAME_BYTES, TRACE_NOISE, TYPE_REF_KINDS
from corpusgraph.corpus import Corpus
from corpusgraph.operators.ranking import top_k
from corpusgraph.runtime import is_empty, materialise

BIN_SHIFT = 6  # bins of 64 lines


def _bin(line: str | Column) -> Column:
    col = F.col(line) if isinstance(line, str) else line
    return F.shiftright(col - 1, BIN_SHIFT)


def binned_ranges(ranges: DataFrame, start: str = "start_line", end: str = "end_line") -> DataFrame:
    bins = F.sequence(_bin(start), _bin(F.greatest(F.col(start), F.col(end))))
    return ranges.withColumn("bin", F.explode(bins))


def binned_points(points: DataFrame, line: str = "line") -> DataFrame:
    return points.withColumn("bin", _bin(line))


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Narrowest symbol around each distinct (file_id, line); lines outside any symbol drop out.

    Ties: larger start line, then smaller symbol id. Points are made distinct first, so many
    calls on one line cost one lookup, and the argmin keeps the join's partitioning because
    the grouping keys include its keys.
    """
    spots = binned_points(points.select("file_id", "line").distinct())
    ranges = binned_ranges(symbols.select("file_id", "symbol_id", "name", "start_line", "end_line"))
    narrow = F.min(
        F.struct(
            (F.col("end_line") - F.col("start_line")).alias("span"),
            (-F.col("start_line")).alias("later"),
            F.col("symbol_id"),
            F.col("name"),
        )
    )
    return (
        spots.join(ranges, ["file_id", "bin"])
        .where("line BETWEEN start_line AND end_line")
        .groupBy("file_id", "bin", "line").agg(narrow.alias("n"))
        .select("file_id", "line", F.col("n.symbol_id").alias("symbol_id"), F.col("n.name").alias("caller"))
    )


def distinct_calls(refs: DataFrame) -> DataFrame:
    """Call sites collapsed to (file, line, callee) before any shuffle by file."""
    return refs.groupBy("repo", "file_id", "line", F.col("name").alias("callee")).agg(
        F.count("*").alias("n_calls")
    )


def call_edges(c: Corpus) -> DataFrame:
    """Calls with the narrowest enclosing symbol as caller; self-calls are left out."""
    owners = enclosing_symbol(c.refs, c.symbols).select("file_id", "line", "caller")
    return distinct_calls(c.refs).join(owners, ["file_id", "line"]).where("caller <> callee")


def _placed_symbols(c: Corpus) -> DataFrame:
    """Symbols with the least (path, rel_path) of their file's rows, and the least by rel_path as ``first``."""
    places = c.files.groupBy("file_id").agg(
        F.min(F.struct("path", "rel_path")).alias("place"), F.min(F.struct("rel_path", "path")).alias("first"))
    return c.symbols.join(places, "file_id")


def lines_around(refs: DataFrame, ranges: DataFrame, fields: list[Column], keep: list[Column] | None = None) -> DataFrame:
    """One row per (repo, file_id, line) with calls: ``callees``, their distinct names, and ``around``, the structs ``fields``
    of the ranges around the line in ascending order. ``keep``: aggregates over the ranges of a bin.

    Calls are shuffled once, to their (file, bin), where they become one row per line and meet the array of the ranges;
    ``file_id`` and ``bin`` are what the result is dealt by."""
    listed = binned_ranges(ranges).groupBy("file_id", "bin").agg(
        F.sort_array(F.collect_list(F.struct(*fields, "start_line", "end_line"))).alias("ranges"), *(keep or []))
    lines = (
        binned_points(refs.select("repo", "file_id", "line", "name")).repartition("file_id", "bin")
        .groupBy("file_id", "bin", "line", "repo").agg(F.collect_set("name").alias("callees"))
    )
    inside = F.filter("ranges", lambda r: F.col("line").between(r["start_line"], r["end_line"]))
    return lines.join(listed, ["file_id", "bin"]).withColumn("around", inside).where("size(around) > 0").drop("ranges")


def impact_edges(c: Corpus, limit: int | None = None) -> DataFrame:
    """Upward edge table: one row per (repo, callee, caller, file) with its first line.

    With ``limit`` the first ``2 * limit`` edges of a name, and some more. They are among the first of each bin number: an
    edge is kept once per bin number there, so no repeat pushes another out, and the rest is cut in front of a shuffle."""
    fields = [
        (F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("later"), F.col("symbol_id"), F.col("name")
    ]
    owned = lines_around(c.refs, _placed_symbols(c), fields, [F.first("place").alias("place")])
    called = owned.select(
        "repo", F.explode("callees").alias("callee"), F.get("around", F.lit(0))["name"].alias("caller"), "file_id", "bin", "line", "place.*")
    key = ["repo", "callee", "caller", "file_id", "path", "rel_path"]
    edges = called.where("caller <> callee").groupBy(*key, "bin").agg(F.min("line").alias("line"))
    if limit is not None:
        edges = top_k(edges, ["repo", "callee", "bin"], ["rel_path", "line", "caller"], 2 * limit).repartition("repo", "callee")
    return edges.groupBy(*key).agg(F.min("line").alias("line")).select("repo", "callee", "caller", "file_id", "line", "path", "rel_path")


def containing_symbols(c: Corpus, symbols: DataFrame | None = None, keep: list[Column] | None = None) -> DataFrame:
    """:func:`lines_around` with the distinct names of all symbols around the line as ``callers``."""
    found = lines_around(c.refs, c.symbols if symbols is None else symbols, [F.col("name")], keep)
    return found.withColumn("callers", F.array_distinct(F.transform("around", lambda r: r["name"]))).drop("around")


def containment_edges(c: Corpus) -> DataFrame:
    """Calls with *every* symbol around them as caller (a nested call also counts outwards).

    Lines meet the symbols around them; the result is distinct per (caller, callee, file, line), as the callers and the
    callees of a line are.
    """
    pairs = containing_symbols(c).select("repo", "file_id", F.explode("callers").alias("caller"), "callees", "line")
    return pairs.select("repo", "file_id", "caller", F.explode("callees").alias("callee"), "line")


def is_project_name(name: str | Column) -> Column:
    """Not a builtin or common library name and at least three bytes long."""
    col = F.col(name) if isinstance(name, str) else name
    return ~col.isin(*TRACE_NOISE) & (F.octet_length(col) >= TRACE_MIN_NAME_BYTES)


def project_callees(refs: DataFrame) -> DataFrame:
    return refs.where(is_project_name("name"))


#: Lines of a caller that are looked at first: most callers need no more of them.
FIRST_LINES = 64


def trace_edges(c: Corpus, limit: int | None = None) -> DataFrame:
    """Downward edge table: one row per (repo, caller, callee) with its first place, and whether
    the callee is defined in the repository.

    With ``limit`` the first ``2 * limit`` edges of a name, and some more. Where the first ``FIRST_LINES`` lines of a caller
    name as many callees, its other lines can add none in front of them, and only those of the other callers are read."""
    lines = containing_symbols(c, _placed_symbols(c), [F.first("first").alias("place")]).select(
        "repo", F.explode("callers").alias("caller"), "callees", "place.*", "line", "file_id")
    wanted = F.filter("callees", lambda x: is_project_name(x) & (x != F.col("caller")))
    lines = lines.withColumn("callees", wanted).where("size(callees) > 0")
    if limit is None:
        edges = _first_places(lines)
    else:
        first = top_k(lines, ["repo", "caller"], ["rel_path", "line", "file_id"], FIRST_LINES, "place")
        first = materialise(first, "first_lines")
        # Callers with fewer lines are whole; of the others, those whose lines name too few are read again, in full.
        named = first.groupBy("repo", "caller").agg(
            F.max("place").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("callees")))).alias("callees"))
        short = materialise(named.where((F.col("n") >= FIRST_LINES) & (F.col("callees") < 2 * limit)).select("repo", "caller"), "short_callers")
        edges = _first_places(first.join(short, ["repo", "caller"], "left_anti"))
        if not is_empty(short):
            edges = edges.unionByName(_first_places(lines.join(short, ["repo", "caller"])))
        edges = top_k(edges, ["repo", "caller"], ["rel_path", "line", "callee"], 2 * limit).drop("rank")
    # As many rows as names: written, so that few are broadcast and the edges stay where they are.
    defined = materialise(c.symbols.select("repo", F.col("name").alias("callee"), F.lit(True).alias("is_defined")).distinct(), "defined_names")
    return edges.join(defined, ["repo", "callee"], "left").withColumn(
        "is_defined", F.coalesce("is_defined", F.lit(False))
    )


def _first_places(lines: DataFrame) -> DataFrame:
    """(repo, caller, callee) with its first place in ``lines`` of callers."""
    first = F.min(F.struct("rel_path", "line", "file_id", "path")).alias("at")
    rows = lines.select("repo", "caller", F.explode("callees").alias("callee"), "rel_path", "line", "file_id", "path")
    return rows.groupBy("repo", "caller", "callee").agg(first).select("repo", "caller", "callee", "at.*")


def type_refs_in_range(c: Corpus, ranges: DataFrame) -> DataFrame:
    """Type-like symbols whose name is called inside each range.

    ``ranges``: range_id, repo, file_id, start_line, end_line. One row per range and symbol
    identity (rel_path, language, kind, name, start_line). Names are distinct per range before
    they meet the symbols.
    """
    held = lines_around(c.refs, ranges.select("range_id", "file_id", "start_line", "end_line"), [F.col("range_id")])
    called = held.select("file_id", "bin", "repo", F.explode(F.transform("around", lambda r: r["range_id"])).alias("range_id"), "callees")
    # Names are distinct per range where the calls lie before they are shuffled; only longer ranges have more to drop then.
    wanted = (
        called.select("file_id", "bin", "repo", "range_id", F.explode("callees").alias("name")).distinct()
        .select("range_id", "repo", "name").distinct()
    )
    types = c.symbols.where(F.col("kind").isin(*TYPE_REF_KINDS)).select(
        "repo", "file_id", "name", "kind", "start_line", "end_line", "language"
    ).join(c.files.select("file_id", "rel_path"), "file_id").drop("file_id")
    identity = ["repo", "rel_path", "language", "kind", "name", "start_line"]
    return wanted.join(types.dropDuplicates(identity), ["repo", "name"])


def nesting(symbols: DataFrame, with_id: bool = False, exact: bool = False) -> DataFrame:
    """Parent and depth of every symbol from the ranges alone; ``with_id`` adds the parent's ``parent_id``.
    ``exact`` compares ``start_pos`` and ``end_pos``, places within lines, instead of the lines.

    Depth is the number of symbols of the file that enclose it, the parent the nearest of them.
    A range encloses another when it covers it and is larger, or equal and earlier by position
    or id. Each inner symbol meets the outer ranges only at its start line's bin.
    """
    ident = ["symbol_id", "start_line", "end_line", "start_col", *(["start_pos", "end_pos"] if exact else [])]
    inner = symbols.select("file_id", *ident).withColumn("bin", _bin("start_line"))
    outer = binned_ranges(
        symbols.select("file_id", "name", *ident)
    ).select("file_id", "bin", F.col("name").alias("o_name"), *[F.col(x).alias("o_" + x) for x in ident])
    encloses = (
        (F.col("o_start_line") <= F.col("start_line")) & (F.col("o_end_line") >= F.col("end_line"))
        & (
            (F.col("o_end_line") - F.col("o_start_line") > F.col("end_line") - F.col("start_line"))
            | (F.col("o_start_col") < F.col("start_col"))
            | ((F.col("o_start_col") == F.col("start_col")) & (F.col("o_symbol_id") < F.col("symbol_id")))
        )
    )
    span = F.col("o_end_line") - F.col("o_start_line")
    if exact:
        larger = (F.col("o_start_pos") < F.col("start_pos")) | (F.col("o_end_pos") > F.col("end_pos"))
        encloses = (
            (F.col("o_start_pos") <= F.col("start_pos")) & (F.col("o_end_pos") >= F.col("end_pos"))
            & (larger | (F.col("o_symbol_id") < F.col("symbol_id")))
        )
        span = F.col("o_end_pos") - F.col("o_start_pos")
    nearest = F.min(
        F.struct(
            span.alias("span"),
            (-F.col("o_start_line")).alias("later"), (-F.col("o_start_col")).alias("right"),
            (-F.col("o_symbol_id")).alias("o_id"), F.col("o_name").alias("name"),
        )
    )
    found = (
        inner.join(outer, ["file_id", "bin"]).where(encloses)
        .groupBy("file_id", "bin", "symbol_id")
        .agg(F.count("*").cast("int").alias("depth"), nearest.alias("n"))
        .select("symbol_id", "depth", F.col("n.name").alias("parent"), *([(-F.col("n.o_id")).alias("parent_id")] if with_id else []))
    )
    return symbols.drop("parent", "depth").join(found, "symbol_id", "left").withColumns({
        "parent": F.coalesce("parent", F.lit("")), "depth": F.coalesce("depth", F.lit(0)),
    })
