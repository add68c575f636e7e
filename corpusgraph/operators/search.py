"""Ranked symbol search over token postings, and literal text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.constants import (
    BM25_B,
    BM25_IDF_FLOOR,
    BM25_K1,
    LIMIT_SEARCH,
    LIMIT_TEXT,
    SNIPPET_CHARS,
)
from corpusgraph.corpus import Corpus, with_files
from corpusgraph.functions.text import tokens
from corpusgraph.operators.ranking import top_k
from corpusgraph.runtime import materialise


def symbol_tokens(symbols: DataFrame) -> DataFrame:
    """Posting table: (repo, symbol_id, col, pos, token); the name is column 0, the kind column 1.

    Write it sorted by token and a lookup becomes a pushed-down range filter.
    """
    both = F.concat(
        F.transform(tokens("name"), lambda t, i: F.struct(F.lit(0).alias("col"), i.alias("pos"), t.alias("token"))),
        F.transform(tokens("kind"), lambda t, i: F.struct(F.lit(1).alias("col"), i.alias("pos"), t.alias("token"))),
    )
    return symbols.select("repo", "symbol_id", F.inline(both))


def query_terms(queries: DataFrame) -> DataFrame:
    """(repo, query, term_no, term, is_prefix, n_terms): all words, the last one as a prefix."""
    return (
        queries.select("repo", "query").distinct()
        .select("repo", "query", F.posexplode(tokens("query")).alias("term_no", "term"), F.size(tokens("query")).alias("n_terms"))
        .withColumn("is_prefix", F.col("term_no") == F.col("n_terms") - 1)
    )


def _term_tokens(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary tokens each distinct (repo, term, is_prefix) stands for. Prefixes meet the
    distinct tokens by equality: a token is cut to the prefix lengths in use (one number per
    length reaches the driver)."""
    keep = ["repo", "term", "is_prefix", "token"]
    whole = terms.where("NOT is_prefix").withColumn("token", F.col("term")).select(keep)
    prefixes = terms.where("is_prefix")
    lengths = sorted(r[0] for r in prefixes.select(F.length("term")).distinct().collect())
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("token"))
    dictionary = postings.select("repo", "token").distinct().withColumn(
        "term", F.explode(F.transform(cuts, lambda n: F.substring(F.col("token"), F.lit(1), n)))
    )
    return whole.unionByName(prefixes.join(dictionary, ["repo", "term"]).select(keep))


def bm25_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """Symbols that match every term of a query with their Okapi BM25 score, per repository.

    ``queries``: repo, query. The score is rounded to six digits; larger is better.

    Matching rows are found once per distinct term and shared by all queries. A query then takes
    its candidates from its rarest term only and looks the other terms up per candidate, so a
    term that holds a third of all symbols (a kind, say) never fans out over the queries.
    """
    postings = symbol_tokens(symbols)
    wanted = query_terms(queries)
    term = ["repo", "term", "is_prefix"]
    term_docs = materialise(
        _term_tokens(postings, wanted.select(*term).distinct()).join(postings, ["repo", "token"])
        .groupBy(*term, "symbol_id").agg(F.count("*").alias("tf")),
        "term_docs",
    )
    # A term without any symbol drops out here, and its query with it (hits < n_terms).
    scored_terms = wanted.join(term_docs.groupBy(*term).agg(F.count("*").alias("df")), term)
    rarest = scored_terms.groupBy("repo", "query").agg(F.min(F.struct("df", "term", "is_prefix")).alias("r"))
    candidates = rarest.select("repo", "query", "r.term", "r.is_prefix").join(term_docs.drop("tf"), term).drop("term", "is_prefix")
    tf = candidates.join(scored_terms, ["repo", "query"]).join(term_docs, [*term, "symbol_id"])

    docs = postings.groupBy("repo", "symbol_id").agg(F.count("*").alias("dl"))
    stats = (
        symbols.groupBy("repo").agg(F.count("*").alias("n_docs"))
        .join(docs.groupBy("repo").agg(F.sum("dl").alias("n_tokens")), "repo")
    )
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(BM25_IDF_FLOOR))
    norm = 1.0 - BM25_B + BM25_B * F.col("dl") * F.col("n_docs") / F.col("n_tokens")
    part = idf * F.col("tf") * (BM25_K1 + 1.0) / (F.col("tf") + BM25_K1 * norm)
    return (
        tf.join(docs, ["repo", "symbol_id"]).join(stats, "repo")
        .groupBy("repo", "query", "n_terms", "symbol_id")
        .agg(F.count("*").alias("hits"), F.round(F.sum(part), 6).alias("score"))
        .where("hits = n_terms")
        .select("repo", "query", "symbol_id", "score")
    )


def search_symbols(
    c: Corpus, queries: DataFrame, kind: str = "", lang: str = "", exact: bool = False, limit: int = LIMIT_SEARCH
) -> DataFrame:
    """Symbol search for a batch of (repo, query): exact names, or ranked prefix search.

    Tier 0 is the name itself, tier 1 a name starting with the query in any case, tier 2 the
    rest; then the score, then the symbol id.
    """
    symbols = c.symbols
    if exact:
        named = queries.select("repo", "query").distinct().withColumn("name", F.col("query"))
        found = symbols.join(named, ["repo", "name"]).withColumns({"tier": F.lit(0), "score": F.lit(0.0)})
    else:
        found = symbols.join(bm25_symbols(symbols, queries), ["repo", "symbol_id"]).withColumn(
            "tier",
            F.when(F.col("name") == F.col("query"), 0)
            .when(F.startswith(F.lower("name"), F.lower("query")), 1).otherwise(2),
        )
    if kind:
        found = found.where(F.col("kind") == kind)
    if lang:
        found = found.where(F.col("language") == lang)
    best = top_k(found, ["repo", "query"], ["tier", F.desc("score"), "symbol_id"], limit)
    return with_files(best, c.files)


def text_search(c: Corpus, query: str, lang: str = "", limit: int | None = LIMIT_TEXT) -> DataFrame:
    """Case-sensitive literal grep over whole lines, ordered by rel_path and line.

    ``limit=None`` returns every hit. The snippet is the first 200 characters of the line; the
    match is looked for in the whole line.
    """
    files = c.files.where(F.col("language") == lang) if lang else c.files
    # Beyond the broadcast limit lines are shuffled to their file: only what is shown of them.
    hits = (
        c.lines.where(F.contains("text", F.lit(query)))
        .select("repo", "file_id", "line", F.substring("text", 1, SNIPPET_CHARS).alias("snippet"))
        .join(files.select("file_id", "path", "rel_path"), "file_id")
        .select("repo", "path", "rel_path", "line", "snippet")
    )
    return hits if limit is None else hits.orderBy("rel_path", "line", "repo").limit(limit)
