"""Repository statistics and the structure report, per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.constants import CALLABLE_KINDS, LIMIT_STRUCTURE
from corpusgraph.corpus import Corpus, with_files
from corpusgraph.functions.paths import package_of
from corpusgraph.functions.text import starts_with_capital
from corpusgraph.operators.imports import top_by_import_fan
from corpusgraph.operators.ranking import top_k


def language_counts(c: Corpus) -> DataFrame:
    return c.files.groupBy("repo", "language").agg(F.count("*").alias("files"))


def repo_stats(c: Corpus) -> DataFrame:
    """Files, symbols and a language -> files map (most files first) per repository."""
    languages = language_counts(c).groupBy("repo").agg(
        F.map_from_entries(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("o"), F.col("language").alias("l")))),
                lambda x: F.struct(x["l"], -x["o"]),
            )
        ).alias("languages"),
        F.sum("files").alias("files"),
    )
    symbols = c.symbols.groupBy("repo").agg(F.count("*").alias("symbols"))
    return languages.join(symbols, "repo", "left").withColumn("symbols", F.coalesce("symbols", F.lit(0)))


def list_repos(c: Corpus) -> DataFrame:
    """Repositories with their file and symbol counts; nameless ones are left out."""
    return repo_stats(c).where("repo <> ''").select("repo", "files", "symbols")


def rows_per_file(c: Corpus) -> DataFrame:
    """Fact rows (symbols + imports + refs) per file, files without facts included."""
    parts = [
        t.groupBy("file_id").agg(F.count("*").alias("n")).select("file_id", F.lit(k).alias("fact"), "n")
        for k, t in (("symbols", c.symbols), ("imports", c.imports), ("refs", c.refs))
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("file_id").agg(
        *[F.coalesce(F.sum(F.when(F.col("fact") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("symbols", "imports", "refs")]
    )
    joined = c.files.select("repo", "file_id", "rel_path").join(counts, "file_id", "left").na.fill(0, ["symbols", "imports", "refs"])
    return joined.withColumn("total_rows", F.col("symbols") + F.col("imports") + F.col("refs"))


def top_by_refs(c: Corpus, limit: int = LIMIT_STRUCTURE) -> DataFrame:
    """Hot names: call sites times top-level definitions of the name in a file.

    Calls and definitions are both counted before they meet, so the fan-out is a product of two
    numbers and not of rows. The first definition in the file stands for it.
    """
    calls = c.refs.groupBy("repo", "name").agg(F.count("*").alias("n_refs"))
    first = F.min(F.struct("start_line", "symbol_id", "kind", "end_line")).alias("s")
    defs = c.symbols.where("depth = 0").groupBy("repo", "name", "file_id").agg(F.count("*").alias("n_defs"), first)
    hot = (
        defs.join(calls, ["repo", "name"]).join(c.files.select("file_id", "rel_path"), "file_id")
        .select("repo", "name", "rel_path", (F.col("n_refs") * F.col("n_defs")).alias("refs"), "s.*")
    )
    return top_k(hot, ["repo"], [F.desc("refs"), F.col("name"), F.col("rel_path")], limit)


def top_packages(c: Corpus, limit: int = LIMIT_STRUCTURE) -> DataFrame:
    """Packages (first two path segments) by number of symbols; files without symbols do not count."""
    per_file = c.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    packages = (
        c.files.select("repo", "file_id", package_of("rel_path").alias("package")).join(per_file, "file_id")
        .groupBy("repo", "package").agg(F.sum("n").alias("symbols"), F.count("*").alias("files"))
    )
    return top_k(packages, ["repo"], [F.desc("symbols"), F.col("package")], limit)


def entry_points(c: Corpus, limit: int = LIMIT_STRUCTURE) -> DataFrame:
    """Top-level callables named main/init, or capitalised functions in a path holding ``main``."""
    callables = with_files(c.symbols.where((F.col("depth") == 0) & F.col("kind").isin(*CALLABLE_KINDS)), c.files)
    named = F.col("name").isin("main", "init", "Main", "Init")
    exported = starts_with_capital("name") & (F.col("kind") == "function") & F.contains(F.lower("rel_path"), F.lit("main"))
    return top_k(callables.where(named | exported), ["repo"], ["name", "rel_path", "start_line", "symbol_id"], limit)


def structure_report(c: Corpus, limit: int = LIMIT_STRUCTURE) -> DataFrame:
    """The whole report as (repo, section, rank, key, value) rows."""
    stats = list_repos(c)
    one = F.lit(1)
    hot = top_by_refs(c, limit)
    suggestions = hot.groupBy("repo", "name").agg(F.min("rank").alias("first"))

    def section(df: DataFrame, name: str, rank, key, value) -> DataFrame:
        return df.select(
            "repo", F.lit(name).alias("section"), rank.cast("int").alias("rank"),
            key.alias("key"), value.cast("bigint").alias("value"),
        )

    col = F.col
    languages = top_k(language_counts(c), ["repo"], [F.desc("files"), col("language")], 2**31 - 1)
    return reduce(DataFrame.unionByName, [
        section(stats, "total", one, F.lit("files"), col("files")),
        section(stats, "total", F.lit(2), F.lit("symbols"), col("symbols")),
        section(languages, "language", col("rank"), col("language"), col("files")),
        section(entry_points(c, limit), "entry_point", col("rank"), F.concat_ws(":", "rel_path", "name"), col("start_line")),
        section(hot, "top_by_refs", col("rank"), F.concat_ws(":", "rel_path", "name"), col("refs")),
        section(top_by_import_fan(c, limit), "top_by_import_fan", col("rank"), col("rel_path"), col("importers")),
        section(top_packages(c, limit), "top_package", col("rank"), col("package"), col("symbols")),
        section(
            top_k(suggestions, ["repo"], ["first", "name"], 3), "suggestion", col("rank"), col("name"), col("first")
        ),
    ])
