"""Symbol lookups for batches of targets: (repo, target) tables in, ranked rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.constants import (
    LIMIT_BUNDLE_MEMBERS,
    LIMIT_REFS,
    LIMIT_RESOLVE_EXACT,
    LIMIT_RESOLVE_FUZZY,
    LIMIT_SEARCH,
    MAX_TYPE_LINES,
    TYPE_KINDS,
)
from corpusgraph.corpus import Corpus, with_files
from corpusgraph.functions.text import dotted_parts, equal_ignoring_case, with_parsed_target
from corpusgraph.operators.ranking import rank_symbols, top_k
from corpusgraph.runtime import materialise
from corpusgraph.operators.edges import binned_points, binned_ranges
from corpusgraph.operators.search import bm25_symbols, search_symbols

KEY = ["repo", "target"]
PLACE_ORDER = ["name", "rel_path", "start_line", "symbol_id"]


def as_targets(c: Corpus, names: list[str]) -> DataFrame:
    """The same target strings looked up in every repository of the corpus."""
    repos = c.files.select("repo").distinct()
    return repos.select("repo", F.explode(F.array(*[F.lit(n) for n in names])).alias("target"))


def _narrow(symbols: DataFrame, kind: str, lang: str) -> DataFrame:
    if kind:
        symbols = symbols.where(F.col("kind") == kind)
    return symbols.where(F.col("language") == lang) if lang else symbols


def symbols_exact(c: Corpus, targets: DataFrame, kind: str = "", lang: str = "", limit: int | None = LIMIT_SEARCH) -> DataFrame:
    """Symbols named exactly like the target."""
    named = targets.select(*KEY).distinct().withColumn("name", F.col("target"))
    found = with_files(_narrow(c.symbols, kind, lang).join(named, ["repo", "name"]), c.files)
    return top_k(found, KEY, PLACE_ORDER, limit)


def symbols_ci(c: Corpus, targets: DataFrame, limit: int | None = LIMIT_SEARCH) -> DataFrame:
    """Symbols whose name equals the target in any casing."""
    folded = targets.select(*KEY, F.lower("target").alias("folded")).distinct()
    found = c.symbols.withColumn("folded", F.lower("name")).join(folded, ["repo", "folded"]).drop("folded")
    return top_k(with_files(found, c.files), KEY, PLACE_ORDER, limit)


def all_files(c: Corpus, lang: str = "") -> DataFrame:
    files = c.files.where(F.col("language") == lang) if lang else c.files
    return files.select("repo", "path", "rel_path").orderBy("rel_path", "repo")


def file_outline(c: Corpus, paths: DataFrame | None = None, signatures: bool = False) -> DataFrame:
    """Symbols per file in line order, with their indent; ``paths`` (repo, path) narrows files."""
    files = c.files.select("repo", "file_id", "path", "rel_path")
    if paths is not None:
        files = files.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    extra = ["signature"] if signatures else []
    return c.symbols.drop("repo").join(files, "file_id").select(
        "repo", "rel_path", "start_line", "end_line", "symbol_id",
        F.expr("repeat('  ', depth)").alias("indent"), "kind", "name", "depth", *extra,
    )


def child_symbols(c: Corpus, parents: DataFrame, limit: int | None = LIMIT_BUNDLE_MEMBERS) -> DataFrame:
    """Members by parent name over the whole repository; ``parents``: repo, target."""
    wanted = parents.select("repo", F.col("target").alias("parent")).distinct()
    found = with_files(c.symbols.where("parent <> ''").join(wanted, ["repo", "parent"]), c.files)
    return top_k(found, ["repo", "parent"], ["start_line", "rel_path", "symbol_id"], limit)


def child_symbols_scoped(c: Corpus, parents: DataFrame, limit: int | None = LIMIT_BUNDLE_MEMBERS) -> DataFrame:
    """Members by parent name within one file; ``parents``: file_id, parent."""
    wanted = parents.select("file_id", "parent").distinct()
    found = c.symbols.where("parent <> ''").join(wanted, ["file_id", "parent"])
    return with_files(top_k(found, ["file_id", "parent"], ["start_line", "symbol_id"], limit), c.files)


def file_imports(c: Corpus) -> DataFrame:
    """Raw imports per file, duplicates kept."""
    return with_files(c.imports, c.files).select("repo", "rel_path", "raw_path")


def find_references(c: Corpus, targets: DataFrame, limit: int | None = LIMIT_REFS) -> DataFrame:
    """Call sites by exact name; per target the first ``limit`` by rel_path and line."""
    named = targets.select(*KEY).distinct().withColumn("name", F.col("target"))
    found = with_files(c.refs.join(named, ["repo", "name"]), c.files)
    return top_k(found, KEY, ["rel_path", "line", "ord"], limit)


def truncated_range(context: int = 0) -> tuple[Column, Column, Column]:
    """(first, last, hidden lines) to show for a symbol.

    Context widens both ends. Type kinds longer than 60 lines show 60 lines from the widened
    start on; ``hidden`` is how many of the symbol's own lines are beyond 60.
    """
    n = F.col("end_line") - F.col("start_line") + 1
    cut = F.col("kind").isin(*TYPE_KINDS) & (n > MAX_TYPE_LINES)
    first = F.greatest(F.lit(1), F.col("start_line") - context)
    last = F.when(cut, first + MAX_TYPE_LINES - 1).otherwise(F.col("end_line") + context)
    return first, last, F.when(cut, n - MAX_TYPE_LINES).otherwise(0)


def source_slice(c: Corpus, ranges: DataFrame) -> DataFrame:
    """Source lines of each (range_id, file_id, first, last), one row per line."""
    return (
        binned_ranges(ranges.select("range_id", "file_id", "first", "last"), "first", "last")
        .join(binned_points(c.lines.select("file_id", "line", "text")), ["file_id", "bin"])
        .where("line BETWEEN first AND last")
        .select("range_id", "file_id", "line", "text")
    )


def parse_targets(targets: DataFrame) -> DataFrame:
    """Target strings as columns: file, parent_hint, symbol, start_line, end_line, is_path."""
    parsed = with_parsed_target(targets.select(*KEY))
    parent, name = dotted_parts("symbol")
    split = (F.col("file") == "") & (F.col("symbol") != "")
    return parsed.withColumns({
        "parent_hint": F.when(split, parent).otherwise(""),
        "symbol": F.when(split, name).otherwise(F.col("symbol")),
    })


def show_lines(c: Corpus, targets: DataFrame, context: int = 0) -> DataFrame:
    """Lines that path targets name: (repo, target, rel_path, line, text).

    ``path:L10-L20`` and ``path:10`` show their lines, widened by ``context`` at both ends (not below line 1); a path
    alone shows the whole file. A path is one of ``path`` or ``rel_path``, as it stands. Targets of other forms,
    unknown files and ranges that end before they start give no rows.
    """
    wanted = parse_targets(targets).where("is_path").select(*KEY, "file", "start_line", "end_line").distinct()
    files = c.files.select("repo", "file_id", "rel_path", "n_lines", F.explode(F.array_distinct(F.array("path", "rel_path"))).alias("file"))
    whole = F.col("start_line") == 0
    first = F.when(whole, 1).otherwise(F.greatest(F.lit(1), F.col("start_line") - context))
    # No further than the file goes, so that a range costs the lines that it holds.
    last = F.when(whole, F.col("n_lines")).otherwise(F.least(F.col("end_line").cast("bigint") + context, F.col("n_lines")))
    place = F.struct(*KEY, "rel_path").alias("range_id")
    ranges = wanted.join(files, ["repo", "file"]).select(
        place, "file_id", first.cast("int").alias("first"), last.cast("int").alias("last")).where("first <= last")
    return source_slice(c, ranges).select("range_id.*", "line", "text")


def _attempts(targets: DataFrame) -> DataFrame:
    """Readings of a target: the whole name first, then ``Parent.name``."""
    parsed = with_parsed_target(targets.select(*KEY).distinct()).select(*KEY, "file", "symbol").where("symbol <> ''")
    parent, name = dotted_parts("symbol")
    whole = F.struct(F.lit(0).alias("attempt"), F.col("symbol").alias("name"), F.lit("").alias("parent_hint"))
    split = F.struct(F.lit(1).alias("attempt"), name.alias("name"), parent.alias("parent_hint"))
    both = F.when((F.col("file") == "") & (parent != ""), F.array(whole, split)).otherwise(F.array(whole))
    return parsed.select(*KEY, "file", F.inline(both)).where("name <> ''")


def _lowest_tier(found: DataFrame, tier: str) -> DataFrame:
    """Keep, per target, the rows of its smallest tier (aggregate and join; no group is held)."""
    best = found.groupBy(*KEY).agg(F.min(tier).alias("best"))
    return found.join(best, KEY).where(F.col(tier) == F.col("best")).drop("best")


def search_flex(c: Corpus, targets: DataFrame, limit: int | None = LIMIT_RESOLVE_FUZZY) -> DataFrame:
    """Any-case name match; only targets without one fall back to the prefix search."""
    folded = targets.select(*KEY, F.lower("target").alias("folded")).distinct()
    known = c.symbols.select("repo", F.lower("name").alias("folded")).distinct()
    missing = folded.join(known, ["repo", "folded"], "left_anti")
    by_prefix = search_symbols(c, missing.select("repo", F.col("target").alias("query")), limit=limit)
    columns = [*KEY, "tier", "rank", "symbol_id", "name", "kind", "rel_path", "start_line"]
    return (
        symbols_ci(c, targets, limit).withColumn("tier", F.lit(0)).select(columns)
        .unionByName(
            by_prefix.withColumns({"target": F.col("query"), "tier": F.lit(1)}).select(columns)
        )
    )


def resolve_hints(candidates: DataFrame) -> DataFrame:
    """Apply file and parent hints to candidates of (repo, target).

    A hint counts only where a target has several candidates and at least one of them fits.
    ``total_found`` is the number of candidates before the hints.
    """
    fits = (
        F.when(F.col("file") != "", F.contains("rel_path", F.col("file")))
        .when(
            F.col("parent_hint") != "",
            equal_ignoring_case(F.col("parent"), F.col("parent_hint")) | F.contains("rel_path", F.col("parent_hint")),
        )
        .otherwise(True)
    )
    # Written once: the counts and the rows that they decide on read the same candidates.
    marked = materialise(candidates.withColumn("fits", fits), "candidates")
    stats = marked.groupBy(*KEY).agg(F.count("*").alias("total_found"), F.max("fits").alias("any_fit"))
    return marked.join(stats, KEY).where("fits OR total_found = 1 OR NOT any_fit").drop("fits", "any_fit")


def candidates_for(c: Corpus, targets: DataFrame) -> DataFrame:
    """Candidate symbols of every target before hints: exact names, else any casing, else the
    prefix search; ``fuzzy`` marks the latter two. No candidate is cut off here.

    The parsed targets are written out: they are read by all three stages, and their string
    expressions would otherwise be evaluated inside every join.
    """
    attempts = materialise(_attempts(targets), "attempts")
    symbols = c.symbols.join(c.files.select("file_id", "path", "rel_path"), "file_id")
    names = c.symbols.select("repo", "name").distinct()

    # Which reading of a target hits is settled on distinct names, before candidates fan out.
    exact = _lowest_tier(attempts.join(names, ["repo", "name"], "left_semi"), "attempt")
    rest = attempts.join(exact.select(*KEY).distinct(), KEY, "left_anti").withColumn("folded", F.lower("name"))
    folded_names = c.symbols.select("repo", F.lower("name").alias("folded")).distinct()
    any_case = _lowest_tier(rest.join(folded_names, ["repo", "folded"], "left_semi"), "attempt")
    last = materialise(rest.join(any_case.select(*KEY).distinct(), KEY, "left_anti"), "prefix_targets")

    hint = [*KEY, "file", "parent_hint"]
    by_name = symbols.join(exact.select(*hint, "name"), ["repo", "name"]).withColumn("fuzzy", F.lit(False))
    by_case = (
        symbols.withColumn("folded", F.lower("name"))
        .join(any_case.select(*hint, "folded"), ["repo", "folded"]).drop("folded")
        .withColumn("fuzzy", F.lit(True))
    )

    matched = bm25_symbols(c.symbols, last.select("repo", F.col("name").alias("query"))).select(
        "repo", F.col("query").alias("q"), "symbol_id"
    )
    prefixed = last.select(*hint, "attempt", F.col("name").alias("q")).join(matched, ["repo", "q"])
    by_prefix = (
        symbols.join(_lowest_tier(prefixed, "attempt").select(*hint, "symbol_id"), ["repo", "symbol_id"])
        .withColumn("fuzzy", F.lit(True))
    )
    return by_name.unionByName(by_case).unionByName(by_prefix)


def flex_resolve(
    c: Corpus, targets: DataFrame, limit: int | None = LIMIT_RESOLVE_EXACT, fuzzy_limit: int | None = LIMIT_RESOLVE_FUZZY
) -> DataFrame:
    """Ranked resolution of every target: rank 1 is the answer.

    Hints and ranking see all candidates; the list limits (100 exact, 20 fuzzy) cut only what is
    reported behind them. ``limit`` None: all that is left after the hints, unranked.
    """
    ranked = rank_symbols(resolve_hints(candidates_for(c, targets)), limit)
    if limit is None or fuzzy_limit is None:
        return ranked
    return ranked.where(~F.col("fuzzy") | (F.col("rank") <= fuzzy_limit))


def auto_resolve(c: Corpus, targets: DataFrame) -> DataFrame:
    """One row per resolved target: the best symbol, its alternatives as ``rel_path:line`` in
    rank order (at most 99), how many candidates there were, and whether the match was fuzzy."""
    place = F.concat_ws(":", "rel_path", F.col("start_line").cast("string"))
    also = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", place.alias("at"))))), lambda x: x["at"]
    )
    best = F.min(F.struct("rank", "symbol_id", "file_id", "name", "kind", "rel_path", "start_line", "end_line"))
    return (
        flex_resolve(c, targets).groupBy(*KEY)
        .agg(best.alias("b"), also.alias("also"), F.max("total_found").alias("total_found"), F.max("fuzzy").alias("fuzzy"))
        .select(*KEY, "b.*", "also", "total_found", "fuzzy").drop("rank")
    )


def ambiguous_symbols(c: Corpus, targets: DataFrame) -> DataFrame:
    """Targets with several exact matches, with the candidates (at most 100) in place order."""
    counts = c.symbols.groupBy("repo", F.col("name").alias("target")).agg(F.count("*").alias("matches"))
    several = targets.select(*KEY).distinct().join(counts.where("matches > 1"), KEY)
    return symbols_exact(c, several, limit=LIMIT_RESOLVE_EXACT).join(several, KEY)


