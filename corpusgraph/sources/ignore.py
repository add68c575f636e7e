"""Ignore rules (.gitignore) as a join: last matching rule wins, ignored folders prune below.

Rules are a table (repo, ord, base_dir, pattern, negated, dir_only, anchored). Every path is
exploded into its ancestors. A rule meets an ancestor on (repo, base_dir), the folder the rule
file lies in, so a repository's rules never meet another one's paths.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_rules(rule_files: DataFrame) -> DataFrame:
    """Rules of (repo, base_dir, content) rule files, in file order.

    ``#`` starts a comment, ``!`` negates, a leading ``/`` anchors, a trailing ``/`` restricts to
    folders. ``ord`` grows with folder depth, so deeper files win over their parents.
    """
    line = F.regexp_replace("raw", r"^\s+|\s+$", "")
    body = F.regexp_replace("line", "^!", "")
    return (
        rule_files.select("repo", "base_dir", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
        .select("repo", "base_dir", "pos", line.alias("line"))
        .where("line <> '' AND line NOT LIKE '#%'")
        .select(
            "repo", "base_dir", "pos", F.startswith("line", F.lit("!")).alias("negated"), body.alias("body")
        )
        .select(
            "repo",
            (F.when(F.col("base_dir") == "", 0).otherwise(F.size(F.split("base_dir", "/"))).cast("bigint") * 1_000_000_000 + F.col("pos")).alias("ord"),
            "base_dir",
            F.regexp_replace(F.regexp_replace("body", "^/", ""), "/$", "").alias("pattern"),
            "negated",
            F.endswith("body", F.lit("/")).alias("dir_only"),
            F.startswith("body", F.lit("/")).alias("anchored"),
        )
        .where("pattern <> ''")
    )


# Pieces of a glob, first match wins: escape, **/ forms, * and ?, class, braces, plain text.
GLOB_PIECE = (
    r"\\.|/\*\*/|/\*\*$|(?<![^/])\*\*/|(?<![^/])\*\*$|\*+|\?|\[[!^]?[^\]]+\]|[{},/]|[^\\*?\[{},/]+|."
)


def glob_regex(pattern: Column, anchored: Column) -> Column:
    """Regular expression for a glob, to be matched against the path below the rule's folder.

    ``**/`` crosses any number of folders (also none), ``/**`` at the end means the folder or
    anything below, ``*`` and ``?`` stay within a segment, ``[...]`` and ``{a,b}`` work as usual,
    backslash escapes. A pattern without a slash looks at the base name; one with a slash that
    is not anchored may match at any later segment.
    """

    def quoted(text: Column) -> Column:
        return F.concat(F.lit("\\Q"), text, F.lit("\\E"))

    def members(t: Column) -> Column:
        """A character class's own text for the regular expression; a range that runs backwards matches nothing,
        as the whole pattern then does."""
        inner = F.regexp_replace(t, "([\\[&^])", "\\\\$1")
        ranges = F.regexp_extract_all(t, F.lit("[^\\[\\]]-[^\\[\\]]"), F.lit(0))
        backwards = F.exists(ranges, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1))
        return F.when(backwards, F.lit(None)).otherwise(inner)

    def bracket(t: Column, start: int, head: str) -> Column:
        own = members(F.substring(t, F.lit(start), F.length(t) - start))
        return F.coalesce(F.concat(F.lit(head), own, F.lit("]")), F.lit("(?!)"))

    def piece(t: Column) -> Column:
        first, second = F.substring(t, 1, 1), F.substring(t, 2, 1)
        braces = F.contains(pattern, F.lit("{"))
        return (
            F.when((first == "\\") & (F.length(t) == 2), quoted(second))
            .when(t == "/**/", "/(?:[^/]+/)*").when(t == "/**", "(?:/.*)?")
            .when(t == "**/", "(?:[^/]+/)*")
            .when((t == "**") & (t == pattern), ".*")
            .when(first == "*", "[^/]*").when(t == "?", "[^/]")
            .when((first == "[") & (F.length(t) > 2) & second.isin("!", "^"), bracket(t, 3, "[^/"))
            .when((first == "[") & (F.length(t) > 2), bracket(t, 2, "["))
            .when((t == "{") & braces, "(?:").when((t == "}") & braces, ")").when((t == ",") & braces, "|")
            .otherwise(quoted(t))
        )

    body = F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(GLOB_PIECE), F.lit(0)), piece), "")
    free = ~anchored | ~F.contains(pattern, F.lit("/"))
    return F.concat(F.when(free, "^(?:.*/)?").otherwise("^"), body, F.lit("$"))


def ignored_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files with ``ignored``: the file itself or any folder above it is ignored.

    ``files``: repo, rel_path. Distinct folders are judged once, however many files they hold;
    a decision is the ``negated`` flag of the matching rule with the largest ``ord``.
    """
    parts = F.split("rel_path", "/")
    n = F.size(parts)
    prefixes = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), (i < n).alias("is_dir")),
    )
    nodes = files.select("repo", "rel_path", F.inline(prefixes))
    verdicts = _ignored_nodes(nodes.select("repo", "node", "is_dir").distinct(), rules)
    hit = (
        nodes.join(verdicts, ["repo", "node", "is_dir"], "left_semi")
        .select("repo", "rel_path").distinct().withColumn("ignored", F.lit(True))
    )
    return files.join(hit, ["repo", "rel_path"], "left").withColumn("ignored", F.coalesce("ignored", F.lit(False)))


def _ignored_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    # Every folder above a node can hold rules for it: '' and each proper prefix.
    parts = F.split("node", "/")
    bases = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    based = nodes.withColumn("base_dir", F.explode(bases))
    below = F.when(F.col("base_dir") == "", F.col("node")).otherwise(
        F.expr("substring(node, length(base_dir) + 2)")
    )
    compiled = rules.withColumn("regex", glob_regex(F.col("pattern"), F.col("anchored"))).select(
        "repo", "base_dir", "ord", "negated", "dir_only", "regex"
    )
    return (
        based.join(compiled, ["repo", "base_dir"])
        .where((~F.col("dir_only") | F.col("is_dir")) & F.regexp_like(below, F.col("regex")))
        .groupBy("repo", "node", "is_dir").agg(F.max(F.struct("ord", "negated")).alias("last"))
        .where("NOT last.negated").select("repo", "node", "is_dir")
    )


def keep_visible(files: DataFrame, rules: DataFrame) -> DataFrame:
    return ignored_files(files, rules).where("NOT ignored").drop("ignored")


