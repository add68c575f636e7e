"""Registered queries: range joins, graph searches, imports, structure, bundles, diffs, refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.constants import LIMIT_IMPACT, LIMIT_IMPORTERS, LIMIT_TRACE, TRACE_NOISE
from corpusgraph.operators import bundle, callsites, diffs, edges, graph, imports, incremental, lookup, quality, structure
from corpusgraph.plans import fixtures as fx
from corpusgraph.plans.queries_lookup import _ranked, names, quoted_list
from corpusgraph.plans.registry import query, view
from corpusgraph.runtime import materialised_once


def impact_edges(spark: SparkSession, sf: str, limit: int | None = LIMIT_IMPACT) -> DataFrame:
    """What searches of up to ``limit`` rows need of the edges, with its ranks; None: all edges, which then need none."""
    def build():
        edge = edges.impact_edges(fx.corpus(spark, sf), limit)
        return edge if limit is None else graph.ranked(edge, "callee", limit)

    return materialised_once(spark, sf, f"impact_edges_{limit or 'all'}", build)


def trace_edges(spark: SparkSession, sf: str) -> DataFrame:
    return materialised_once(
        spark, sf, "trace_edges", lambda: graph.ranked(edges.trace_edges(fx.corpus(spark, sf), LIMIT_TRACE), "caller", LIMIT_TRACE))


def import_edges(spark: SparkSession, sf: str) -> DataFrame:
    return materialised_once(spark, sf, "import_edges", lambda: graph.ranked(
        imports.import_edges(fx.corpus(spark, sf), limit=LIMIT_IMPORTERS), "stem", LIMIT_IMPORTERS))


def joined(array: Column, *fields: str) -> Column:
    """Array of structs as text, so that both engines compare plain strings."""
    return F.coalesce(
        F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ","), F.lit("")
    )


# ---------------------------------------------------------------- range joins

view(
    "ox_owner",
    """SELECT file_id, line, symbol_id, name AS caller FROM
       (SELECT p.file_id, p.line, s.symbol_id, s.name, row_number() OVER (PARTITION BY p.file_id, p.line
               ORDER BY s.end_line - s.start_line, s.start_line DESC, s.symbol_id) AS rn
        FROM (SELECT DISTINCT file_id, line FROM fx_refs) p
        JOIN fx_symbols s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line) x WHERE rn = 1""",
)
view(
    "ox_call_edges",
    """SELECT r.repo, r.file_id, r.line, r.name AS callee, count(*) AS n_calls, o.caller
       FROM fx_refs r JOIN ox_owner o ON o.file_id = r.file_id AND o.line = r.line WHERE o.caller <> r.name
       GROUP BY r.repo, r.file_id, r.line, r.name, o.caller""",
)
view(
    "ox_containment",
    """SELECT DISTINCT r.repo, r.file_id, s.name AS caller, r.name AS callee, r.line
       FROM fx_refs r JOIN fx_symbols s ON s.file_id = r.file_id AND r.line BETWEEN s.start_line AND s.end_line""",
)


@query("enclosing_symbol", "SELECT file_id, line, symbol_id, caller FROM ox_owner")
def enclosing_symbol(spark, sf):
    c = fx.corpus(spark, sf)
    return edges.enclosing_symbol(c.refs, c.symbols)


@query("call_edges", "SELECT repo, file_id, line, callee, n_calls, caller FROM ox_call_edges")
def call_edges(spark, sf):
    return edges.call_edges(fx.corpus(spark, sf))


@query("containment_edges", "SELECT repo, file_id, caller, callee, line FROM ox_containment")
def containment_edges(spark, sf):
    return edges.containment_edges(fx.corpus(spark, sf))


@query(
    "type_refs_in_range",
    """SELECT DISTINCT s.symbol_id AS range_id, t.repo, t.name, t.kind, t.rel_path, t.start_line, t.end_line, t.language
       FROM fx_symbols s JOIN fx_refs r ON r.file_id = s.file_id AND r.line BETWEEN s.start_line AND s.end_line
       JOIN ox_symfile t ON t.repo = r.repo AND t.name = r.name AND t.kind = 'class'""",
)
def type_refs_in_range(spark, sf):
    c = fx.corpus(spark, sf)
    return edges.type_refs_in_range(c, c.symbols.withColumn("range_id", F.col("symbol_id")))


@query(
    "nesting",
    """SELECT s.symbol_id, CAST(count(o.symbol_id) AS INT) AS depth,
       coalesce(arg_min(o.name, (o.end_line - o.start_line) * 1000000 - o.start_line), '') AS parent
       FROM fx_symbols s LEFT JOIN fx_symbols o ON o.file_id = s.file_id AND o.start_line <= s.start_line AND o.end_line >= s.end_line
       AND (o.end_line - o.start_line > s.end_line - s.start_line OR o.symbol_id < s.symbol_id) GROUP BY s.symbol_id""",
)
def nesting(spark, sf):
    return edges.nesting(fx.corpus(spark, sf).symbols).select("symbol_id", "depth", "parent")


# ---------------------------------------------------------------- graph searches

view(
    "ox_impact_edges",
    """SELECT e.repo, e.callee, e.caller, e.file_id, f.rel_path, min(e.line) AS line
       FROM ox_call_edges e JOIN fx_files f ON f.file_id = e.file_id GROUP BY ALL""",
)
def _impact_levels(full: str = "HAVING count(*) >= 100") -> str:
    """Breadth-first levels; targets of the groups that ``full`` keeps go no further."""
    return f"""
    WITH l1 AS (SELECT t.repo, t.target, e.callee AS symbol, e.caller, e.file_id, e.rel_path, e.line, 1 AS depth
                FROM fx_names t JOIN ox_impact_edges e ON e.repo = t.repo AND e.callee = t.target),
    full1 AS (SELECT repo, target FROM l1 GROUP BY ALL {full}),
    f2 AS (SELECT DISTINCT repo, target, caller AS name FROM l1 WHERE caller <> target
           AND NOT EXISTS (SELECT 1 FROM full1 f WHERE f.repo = l1.repo AND f.target = l1.target)),
    c2 AS (SELECT f2.repo, f2.target, e.callee AS symbol, e.caller, e.file_id, e.rel_path, e.line,
                  row_number() OVER (PARTITION BY f2.repo, f2.target, e.caller, e.file_id ORDER BY e.callee, e.line) AS rn
           FROM f2 JOIN ox_impact_edges e ON e.repo = f2.repo AND e.callee = f2.name),
    l2 AS (SELECT repo, target, symbol, caller, file_id, rel_path, line, 2 AS depth FROM c2 WHERE rn = 1
           AND NOT EXISTS (SELECT 1 FROM l1 WHERE l1.repo = c2.repo AND l1.target = c2.target AND l1.caller = c2.caller AND l1.file_id = c2.file_id))
    SELECT *, CAST(row_number() OVER (PARTITION BY repo, target ORDER BY depth, symbol, rel_path, line, caller) AS INT) AS rank
    FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) u"""


view("ox_impact_levels", _impact_levels())
_IMPACT = ["repo", "target", "symbol", "caller", "rel_path", "line", "depth", "rank"]


@query("impact_all", f"SELECT {', '.join(_IMPACT[:-1])} FROM ({_impact_levels('HAVING false')}) x")
def impact_all(spark, sf):
    return graph.find_impact(impact_edges(spark, sf, None), names(spark, sf), limit=None).select(_IMPACT[:-1])


@query("impact", f"SELECT {', '.join(_IMPACT)} FROM ox_impact_levels WHERE rank <= 100")
def impact(spark, sf):
    return graph.find_impact(impact_edges(spark, sf), names(spark, sf)).select(_IMPACT)


view(
    "ox_trace_edges",
    f"""SELECT repo, caller, callee, rel_path, line, EXISTS (SELECT 1 FROM fx_symbols s WHERE s.repo = x.repo AND s.name = x.callee) AS is_defined
        FROM (SELECT c.repo, c.caller, c.callee, f.rel_path, c.line,
              row_number() OVER (PARTITION BY c.repo, c.caller, c.callee ORDER BY f.rel_path, c.line) AS rn
              FROM ox_containment c JOIN fx_files f ON f.file_id = c.file_id
              WHERE c.caller <> c.callee AND strlen(c.callee) > 2 AND c.callee NOT IN ({quoted_list(TRACE_NOISE)})) x WHERE rn = 1""",
)
_TRACE_STEP = """
    l{d} AS (SELECT f.repo, f.target, e.caller, e.callee, e.rel_path, e.line, e.is_defined, {d} AS depth
             FROM f{d} f JOIN ox_trace_edges e ON e.repo = f.repo AND e.caller = f.name)"""


def _trace_frontier(d: int) -> str:
    past = " UNION ALL ".join(f"SELECT repo, target FROM l{i}" for i in range(1, d))
    seen = " UNION ALL ".join(f"SELECT repo, target, name FROM f{i}" for i in range(1, d))
    return f"""
    full{d} AS (SELECT repo, target FROM ({past}) GROUP BY ALL HAVING count(*) >= 50),
    f{d} AS (SELECT DISTINCT repo, target, callee AS name FROM l{d - 1} l WHERE is_defined
             AND NOT EXISTS (SELECT 1 FROM full{d} x WHERE x.repo = l.repo AND x.target = l.target)
             AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.repo = l.repo AND s.target = l.target AND s.name = l.callee))"""


view(
    "ox_trace_levels",
    "WITH f1 AS (SELECT repo, target, target AS name FROM fx_names),"
    + ",".join([_TRACE_STEP.format(d=1), _trace_frontier(2), _TRACE_STEP.format(d=2), _trace_frontier(3), _TRACE_STEP.format(d=3)])
    + """ SELECT *, CAST(row_number() OVER (PARTITION BY repo, target ORDER BY depth, caller, rel_path, line, callee) AS INT) AS rank
          FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) u""",
)
_TRACE = ["repo", "target", "caller", "callee", "rel_path", "line", "is_defined", "depth", "rank"]


@query("callees_all", """SELECT t.repo, t.target, e.caller, e.callee, e.rel_path, e.line, e.is_defined, 1 AS depth
    FROM fx_names t JOIN ox_trace_edges e ON e.repo = t.repo AND e.caller = t.target""")
def callees_all(spark, sf):
    """One level: over three, every name here reaches nearly every other, and the rows are their product."""
    return graph.find_trace(edges.trace_edges(fx.corpus(spark, sf)), names(spark, sf), depth=1, limit=None).select(_TRACE[:-1])


@query("trace", f"SELECT {', '.join(_TRACE)} FROM ox_trace_levels WHERE rank <= 50")
def trace(spark, sf):
    return graph.find_trace(trace_edges(spark, sf), names(spark, sf)).select(_TRACE)


@query("defining_files", "SELECT DISTINCT s.repo, s.name AS target, s.rel_path FROM ox_symfile s")
def defining_files(spark, sf):
    return graph.defining_files(fx.corpus(spark, sf), names(spark, sf))


@query(
    "impact_by_depth",
    """SELECT i.repo, i.target, i.depth, i.rel_path, trim(l.text, ' ' || chr(9)) AS source, count(*) AS sites,
       string_agg(i.line, ',' ORDER BY i.line) AS lines, min(i.line) AS first_line
       FROM ox_impact_levels i JOIN fx_lines l ON l.file_id = i.file_id AND l.line = i.line WHERE i.rank <= 100
       GROUP BY i.repo, i.target, i.depth, i.rel_path, trim(l.text, ' ' || chr(9))""",
)
def impact_by_depth(spark, sf):
    found = graph.find_impact(impact_edges(spark, sf), names(spark, sf))
    return callsites.impact_by_depth(fx.corpus(spark, sf), found).withColumn("lines", F.array_join("lines", ","))


@query(
    "tree_nodes",
    """SELECT DISTINCT repo, array_to_string(parts[1:i - 1], '/') AS parent, array_to_string(parts[1:i], '/') AS path, parts[i] AS name,
       i < len(parts) AS is_dir, CAST(i AS INT) AS depth
       FROM (SELECT repo, string_split(rel_path, '/') AS parts, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS i FROM fx_files) x""",
)
def tree_nodes(spark, sf):
    return graph.tree_nodes(fx.corpus(spark, sf).files)


# ---------------------------------------------------------------- imports

_STEM = "regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '[.][^.]*$', '')"
view(
    "ox_stem_match",
    f"""SELECT p.repo, p.stem, i.raw_path FROM (SELECT DISTINCT repo, {_STEM.format(p='rel_path')} AS stem FROM fx_files) p
        JOIN (SELECT DISTINCT repo, raw_path FROM fx_imports) i ON i.repo = p.repo AND contains(lower(i.raw_path), lower(p.stem))""",
)


@query("import_match_stem", "SELECT repo, stem, raw_path FROM ox_stem_match")
def import_match_stem(spark, sf):
    return imports.import_match_stem(fx.corpus(spark, sf))


@query(
    "import_match_path",
    f"""SELECT DISTINCT f.repo, f.rel_path, i.raw_path FROM fx_files f JOIN (SELECT DISTINCT repo, raw_path FROM fx_imports) i
        ON i.repo = f.repo AND (ends_with(lower(i.raw_path), lower(f.rel_path)) OR contains(lower(i.raw_path), lower({_STEM.format(p='f.rel_path')})))""",
)
def import_match_path(spark, sf):
    return imports.import_match_path(fx.corpus(spark, sf))


view(
    "ox_import_edges",
    f"""SELECT m.repo, m.stem, i.file_id, f.rel_path, min(m.raw_path) AS import, {_STEM.format(p='f.rel_path')} AS importer_stem
        FROM ox_stem_match m JOIN (SELECT DISTINCT repo, raw_path, file_id FROM fx_imports) i ON i.repo = m.repo AND i.raw_path = m.raw_path
        JOIN fx_files f ON f.file_id = i.file_id GROUP BY m.repo, m.stem, i.file_id, f.rel_path""",
)
view(
    "ox_importers2",
    f"""
    WITH f1 AS (SELECT DISTINCT s.repo, s.name AS target, {_STEM.format(p='s.rel_path')} AS stem FROM ox_symfile s),
    c1 AS (SELECT f.repo, f.target, e.file_id, e.rel_path, e.importer_stem, min(e.import) AS import FROM f1 f
           JOIN ox_import_edges e ON e.repo = f.repo AND e.stem = f.stem GROUP BY ALL),
    full1 AS (SELECT repo, target FROM c1 GROUP BY ALL HAVING count(*) >= 50),
    f2 AS (SELECT DISTINCT repo, target, importer_stem AS stem FROM c1
           WHERE NOT EXISTS (SELECT 1 FROM full1 x WHERE x.repo = c1.repo AND x.target = c1.target)
           AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.repo = c1.repo AND f1.target = c1.target AND f1.stem = c1.importer_stem)),
    c2 AS (SELECT f.repo, f.target, e.file_id, e.rel_path, e.importer_stem, min(e.import) AS import FROM f2 f
           JOIN ox_import_edges e ON e.repo = f.repo AND e.stem = f.stem
           WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE c1.repo = f.repo AND c1.target = f.target AND c1.file_id = e.file_id) GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (PARTITION BY repo, target ORDER BY depth, rel_path) AS INT) AS rank
    FROM (SELECT *, 1 AS depth FROM c1 UNION ALL SELECT *, 2 FROM c2) u""",
)
_IMPORTERS = ["repo", "target", "rel_path", "import", "depth", "rank"]


@query("importers_by_symbol", f"SELECT {', '.join(_IMPORTERS)} FROM ox_importers2 WHERE rank <= 50 AND depth = 1")
def importers_by_symbol(spark, sf):
    return graph.find_importers(fx.corpus(spark, sf), import_edges(spark, sf), names(spark, sf)).select(_IMPORTERS)


@query("refs_impact", f"SELECT {', '.join(_IMPORTERS)} FROM ox_importers2 WHERE rank <= 50")
def refs_impact(spark, sf):
    return graph.refs_impact(fx.corpus(spark, sf), import_edges(spark, sf), names(spark, sf)).select(_IMPORTERS)


@query("importers_by_path", f"""
    , t AS (SELECT repo, rel_path AS target FROM fx_files UNION SELECT repo, raw_path FROM fx_imports
            UNION SELECT DISTINCT repo, 'no/such.module' FROM fx_files UNION SELECT repo, upper(raw_path) FROM fx_imports),
    m AS (SELECT f.repo, f.target, i.file_id, g.rel_path, min(i.raw_path) AS import, 1 AS depth FROM t f
    JOIN (SELECT DISTINCT repo, raw_path, file_id FROM fx_imports) i ON i.repo = f.repo
      AND (ends_with(lower(i.raw_path), lower(f.target)) OR contains(lower(i.raw_path), lower({_STEM.format(p='f.target')})))
    JOIN fx_files g ON g.file_id = i.file_id GROUP BY f.repo, f.target, i.file_id, g.rel_path)
    """ + _ranked("repo, target, rel_path, import, depth", "SELECT * FROM m", "repo, target", "rel_path", 50))
def importers_by_path(spark, sf):
    """Targets: every file, every import string as it is and in capitals, and one that nobody imports."""
    c = fx.corpus(spark, sf)
    raw = c.imports.select("repo", F.col("raw_path").alias("target"))
    targets = (
        c.files.select("repo", F.col("rel_path").alias("target")).union(raw).union(raw.withColumn("target", F.upper("target")))
        .union(c.files.select("repo", F.lit("no/such.module").alias("target"))).distinct()
    )
    return graph.find_importers_by_path(c, import_edges(spark, sf), targets).select(_IMPORTERS)


view("ox_fan", _ranked(
    "repo, rel_path, language, importers",
    """SELECT f.repo, f.rel_path, f.language, count(DISTINCT i.file_id) AS importers FROM fx_files f
       JOIN (SELECT DISTINCT repo, raw_path, file_id FROM fx_imports) i ON i.repo = f.repo AND contains(lower(i.raw_path), lower(replace(f.rel_path, '/', '.')))
       GROUP BY f.repo, f.rel_path, f.language HAVING count(DISTINCT i.file_id) > 1""",
    "repo", "importers DESC, rel_path", 10))


@query("top_by_import_fan", "SELECT repo, rel_path, language, importers, rank FROM ox_fan")
def top_by_import_fan(spark, sf):
    return imports.top_by_import_fan(fx.corpus(spark, sf))


# ---------------------------------------------------------------- statistics and structure

view("ox_stats", """SELECT f.repo, f.files, coalesce(s.symbols, 0) AS symbols FROM (SELECT repo, count(*) AS files FROM fx_files GROUP BY repo) f
     LEFT JOIN (SELECT repo, count(*) AS symbols FROM fx_symbols GROUP BY repo) s ON s.repo = f.repo""")


@query(
    "repo_stats",
    """SELECT s.repo, s.files, s.symbols, l.languages FROM ox_stats s
       JOIN (SELECT repo, string_agg(language || ':' || n, ',' ORDER BY n DESC, language) AS languages
             FROM (SELECT repo, language, count(*) AS n FROM fx_files GROUP BY ALL) x GROUP BY repo) l ON l.repo = s.repo""",
)
def repo_stats(spark, sf):
    return structure.repo_stats(fx.corpus(spark, sf)).withColumn("languages", joined(F.map_entries("languages"), "key", "value"))


@query("language_counts", "SELECT repo, language, count(*) AS files FROM fx_files GROUP BY repo, language")
def language_counts(spark, sf):
    return structure.language_counts(fx.corpus(spark, sf))


@query("list_repos", "SELECT repo, files, symbols FROM ox_stats WHERE repo <> ''")
def list_repos(spark, sf):
    return structure.list_repos(fx.corpus(spark, sf))


@query(
    "rows_per_file",
    """SELECT *, symbols + imports + refs AS total_rows FROM (SELECT f.repo, f.file_id, f.rel_path, coalesce(s.n, 0) AS symbols,
       coalesce(i.n, 0) AS imports, coalesce(r.n, 0) AS refs FROM fx_files f
       LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_symbols GROUP BY 1) s ON s.file_id = f.file_id
       LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_imports GROUP BY 1) i ON i.file_id = f.file_id
       LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_refs GROUP BY 1) r ON r.file_id = f.file_id) x""",
)
def rows_per_file(spark, sf):
    return structure.rows_per_file(fx.corpus(spark, sf))


view("ox_hot", _ranked(
    "repo, name, rel_path, refs, start_line, symbol_id, kind, end_line",
    """SELECT d.repo, d.name, d.rel_path, r.n * d.n AS refs, d.start_line, d.symbol_id, d.kind, d.end_line FROM
       (SELECT repo, name, rel_path, count(*) AS n, min(start_line) AS start_line, arg_min(symbol_id, symbol_id) AS symbol_id,
               arg_min(kind, symbol_id) AS kind, arg_min(end_line, symbol_id) AS end_line FROM ox_symfile WHERE depth = 0 GROUP BY repo, name, rel_path) d
       JOIN (SELECT repo, name, count(*) AS n FROM fx_refs GROUP BY ALL) r ON r.repo = d.repo AND r.name = d.name""",
    "repo", "refs DESC, name, rel_path", 10))


@query("top_by_refs", "SELECT * FROM ox_hot")
def top_by_refs(spark, sf):
    return structure.top_by_refs(fx.corpus(spark, sf))


view("ox_packages", _ranked(
    "repo, package, symbols, files",
    """SELECT repo, CASE WHEN contains(rel_path, '/') THEN array_to_string(string_split(rel_path, '/')[1:2], '/') ELSE '.' END AS package,
       count(*) AS symbols, count(DISTINCT file_id) AS files FROM ox_symfile GROUP BY 1, 2""",
    "repo", "symbols DESC, package", 10))


@query("top_packages", "SELECT repo, package, symbols, files, rank FROM ox_packages")
def top_packages(spark, sf):
    return structure.top_packages(fx.corpus(spark, sf))


view("ox_entry", _ranked(
    "repo, name, kind, rel_path, start_line, symbol_id",
    """SELECT * FROM ox_symfile WHERE depth = 0 AND kind IN ('function', 'method') AND (name IN ('main', 'init', 'Main', 'Init')
       OR (regexp_matches(name, '^[A-Z]') AND kind = 'function' AND contains(lower(rel_path), 'main')))""",
    "repo", "name, rel_path, start_line, symbol_id", 10))


@query("entry_points", "SELECT repo, name, kind, rel_path, start_line, symbol_id, rank FROM ox_entry")
def entry_points(spark, sf):
    return structure.entry_points(fx.corpus(spark, sf)).select("repo", "name", "kind", "rel_path", "start_line", "symbol_id", "rank")


@query(
    "structure_report",
    """SELECT repo, 'total' AS section, 1 AS rank, 'files' AS key, files AS value FROM ox_stats
    UNION ALL SELECT repo, 'total', 2, 'symbols', symbols FROM ox_stats
    UNION ALL SELECT repo, 'language', CAST(row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS INT), language, n
              FROM (SELECT repo, language, count(*) AS n FROM fx_files GROUP BY ALL) l
    UNION ALL SELECT repo, 'entry_point', rank, rel_path || ':' || name, start_line FROM ox_entry
    UNION ALL SELECT repo, 'top_by_refs', rank, rel_path || ':' || name, refs FROM ox_hot
    UNION ALL SELECT repo, 'top_by_import_fan', rank, rel_path, importers FROM ox_fan
    UNION ALL SELECT repo, 'top_package', rank, package, symbols FROM ox_packages
    UNION ALL SELECT repo, 'suggestion', CAST(rn AS INT), name, first FROM (SELECT repo, name, first, row_number() OVER (PARTITION BY repo ORDER BY first, name) AS rn
              FROM (SELECT repo, name, min(rank) AS first FROM ox_hot GROUP BY ALL) x) y WHERE rn <= 3""",
)
def structure_report(spark, sf):
    return structure.structure_report(fx.corpus(spark, sf))


# ---------------------------------------------------------------- call sites


@query(
    "dedup_call_sites",
    """SELECT r.repo, r.target, r.rel_path, trim(l.text, ' ' || chr(9)) AS source, count(*) AS sites,
       string_agg(r.line, ',' ORDER BY r.line) AS lines, min(r.line) AS first_line
       FROM ox_refs50 r JOIN fx_lines l ON l.file_id = r.file_id AND l.line = r.line
       GROUP BY r.repo, r.target, r.rel_path, trim(l.text, ' ' || chr(9))""",
)
def dedup_call_sites(spark, sf):
    c = fx.corpus(spark, sf)
    sites = callsites.with_source(c, lookup.find_references(c, names(spark, sf)), 0)
    return callsites.dedup_call_sites(sites, ["repo", "target"]).withColumn("lines", F.array_join("lines", ","))


@query(
    "context_window",
    """SELECT r.file_id, r.line, min(l.line) AS context_start, string_agg(rtrim(l.text, ' ' || chr(9)), chr(10) ORDER BY l.line) AS context
       FROM (SELECT DISTINCT file_id, line FROM fx_refs) r JOIN fx_lines l ON l.file_id = r.file_id AND l.line BETWEEN r.line - 1 AND r.line + 1
       GROUP BY r.file_id, r.line""",
)
def context_window(spark, sf):
    c = fx.corpus(spark, sf)
    return callsites.context_window(c, c.refs, 1).select(
        "file_id", "line", "context_start", F.array_join("context_lines", "\n").alias("context")
    )


@query(
    "output_cost",
    """
    , looked AS (SELECT s.repo, s.target, sum(strlen(s.rel_path || ':' || s.line || ':' || l.text) + 1) AS b
        FROM (SELECT DISTINCT repo, target, file_id, rel_path, line FROM ox_refs50 WHERE rank <= 20) s
        JOIN fx_lines l ON l.file_id = s.file_id AND l.line = s.line GROUP BY s.repo, s.target),
    grep AS (SELECT t.repo, t.target, sum(strlen(f.rel_path || ':' || l.line || ':' || l.text) + 1) AS b
        FROM fx_names t JOIN fx_lines l ON l.repo = t.repo AND contains(l.text, t.target)
        JOIN fx_files f ON f.file_id = l.file_id GROUP BY t.repo, t.target)
    SELECT t.repo, t.target, CAST(coalesce(k.b, 0) AS BIGINT) AS lookup_bytes, CAST(coalesce(g.b, 0) AS BIGINT) AS grep_bytes,
      CASE WHEN coalesce(g.b, 0) > 0 THEN round(100.0 * (1 - coalesce(k.b, 0)::DOUBLE / g.b::DOUBLE), 2) END AS saving_pct
    FROM fx_names t LEFT JOIN looked k ON k.repo = t.repo AND k.target = t.target LEFT JOIN grep g ON g.repo = t.repo AND g.target = t.target""",
)
def output_cost(spark, sf):
    return callsites.output_cost(fx.corpus(spark, sf), names(spark, sf), 20)


# ---------------------------------------------------------------- diffs

_HUNK_END = "start_line + CASE cnt WHEN 2 THEN 1 ELSE 0 END"


@query("parse_hunks", f"""SELECT repo, file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS INT) AS hunk_no, header,
       start_line AS new_start, {_HUNK_END} AS new_end FROM fx_hunks""")
def parse_hunks(spark, sf):
    return diffs.parse_hunks(diffs.patch_lines(fx.patches(spark, sf)))


view("ox_overlap", f"""SELECT s.repo, s.file_id, s.symbol_id, s.name, s.start_line, s.end_line, h.hunk_no, h.new_start, h.new_end, h.header, h.hname
     FROM fx_symbols s JOIN (SELECT *, name AS hname, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start_line) AS INT) AS hunk_no,
     start_line AS new_start, {_HUNK_END} AS new_end FROM fx_hunks) h ON h.file_id = s.file_id AND h.new_start <= s.end_line AND h.new_end >= s.start_line""")


@query("diff_overlap", "SELECT repo, file_id, symbol_id, name, start_line, end_line, hunk_no, new_start, new_end FROM ox_overlap")
def diff_overlap(spark, sf):
    hunks = diffs.parse_hunks(diffs.patch_lines(fx.patches(spark, sf)))
    return diffs.diff_overlap(hunks, fx.corpus(spark, sf).symbols)


@query(
    "symbol_diff",
    """SELECT o.repo, o.file_id, o.symbol_id, o.name, count(*) AS hunks,
       'diff --git a/' || f.rel_path || ' b/' || f.rel_path || chr(10) || 'index 1..2 100644' || chr(10) || '--- a/' || f.rel_path || chr(10)
       || '+++ b/' || f.rel_path || chr(10)
       || string_agg(o.header || chr(10) || '-old' || chr(10) || '+' || o.hname || chr(10) || ' same', chr(10) ORDER BY o.hunk_no) AS diff
       FROM ox_overlap o JOIN fx_files f ON f.file_id = o.file_id GROUP BY o.repo, o.file_id, o.symbol_id, o.name, f.rel_path""",
)
def symbol_diff(spark, sf):
    return diffs.symbol_diff(fx.patches(spark, sf), fx.corpus(spark, sf).symbols)


@query("diff_stat", "SELECT repo, file_id, count(*) AS added, count(*) AS removed FROM fx_hunks GROUP BY repo, file_id")
def diff_stat(spark, sf):
    return diffs.diff_stat(fx.patches(spark, sf))


@query(
    "changed_symbols",
    """
    , o AS (SELECT repo, rel_path, kind, parent, name, string_agg(body_hash, ',' ORDER BY start_line, body_hash) AS b FROM fx_old GROUP BY ALL),
    n AS (SELECT repo, rel_path, kind, parent, name, string_agg(body_hash, ',' ORDER BY start_line, body_hash) AS b FROM fx_bodies GROUP BY ALL)
    SELECT * FROM (SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.rel_path, n.rel_path) AS rel_path, coalesce(o.kind, n.kind) AS kind,
      coalesce(o.parent, n.parent) AS parent, coalesce(o.name, n.name) AS name,
      CASE WHEN o.b IS NULL THEN 'added' WHEN n.b IS NULL THEN 'removed' WHEN o.b <> n.b THEN 'changed' END AS status
      FROM o FULL JOIN n ON o.repo = n.repo AND o.rel_path = n.rel_path AND o.kind = n.kind AND o.parent = n.parent AND o.name = n.name) x
    WHERE status IS NOT NULL""",
)
def changed_symbols(spark, sf):
    return diffs.changed_symbols(fx.old_symbols(spark, sf), diffs.symbol_bodies(fx.corpus(spark, sf)))


# ---------------------------------------------------------------- refresh

view(
    "ox_status",
    """SELECT coalesce(c.repo, s.repo) AS repo, coalesce(c.path, s.path) AS path,
       CASE WHEN c.path IS NULL THEN 'stale' WHEN s.path IS NULL THEN 'new'
            WHEN c.mtime_us = s.mtime_us AND c.size = s.size THEN 'unchanged' ELSE 'changed' END AS status
       FROM fx_files c FULL JOIN fx_stored s ON s.repo = c.repo AND s.path = c.path""",
)


@query("classify_changes", "SELECT repo, path, status FROM ox_status")
def classify_changes(spark, sf):
    return incremental.classify_changes(fx.current_snapshot(spark, sf), fx.stored_snapshot(spark, sf))


@query("classify_changes_forced", "SELECT repo, path, CASE WHEN status = 'unchanged' THEN 'changed' ELSE status END AS status FROM ox_status")
def classify_changes_forced(spark, sf):
    return incremental.classify_changes(fx.current_snapshot(spark, sf), fx.stored_snapshot(spark, sf), force=True)


@query("stale_paths", "SELECT repo, path FROM ox_status WHERE status = 'stale'")
def stale_paths(spark, sf):
    return incremental.stale_paths(fx.current_snapshot(spark, sf), fx.stored_snapshot(spark, sf))


@query(
    "upsert_files",
    """SELECT repo, path, language, mtime_us, size FROM fx_stored s WHERE NOT EXISTS
       (SELECT 1 FROM ox_status o WHERE o.repo = s.repo AND o.path = s.path AND o.status IN ('new', 'changed'))
       UNION ALL SELECT f.repo, f.path, f.language, f.mtime_us, f.size FROM fx_files f JOIN ox_status o ON o.repo = f.repo AND o.path = f.path
       WHERE o.status IN ('new', 'changed')""",
)
def upsert_files(spark, sf):
    current = fx.current_snapshot(spark, sf)
    dirty = classify_changes(spark, sf).where("status IN ('new', 'changed')")
    return incremental.upsert_files(fx.stored_snapshot(spark, sf), current.join(dirty, ["repo", "path"], "left_semi"))


@query(
    "prune_stale",
    """
    , gone AS (SELECT f.file_id FROM fx_files f JOIN labels l ON l.doc_id = f.file_id WHERE l.toxic = 1)
    SELECT 'files' AS fact, repo, count(*) AS n FROM fx_files WHERE file_id NOT IN (SELECT file_id FROM gone) GROUP BY repo
    UNION ALL SELECT 'lines', repo, count(*) FROM fx_lines WHERE file_id NOT IN (SELECT file_id FROM gone) GROUP BY repo
    UNION ALL SELECT 'symbols', repo, count(*) FROM fx_symbols WHERE file_id NOT IN (SELECT file_id FROM gone) GROUP BY repo
    UNION ALL SELECT 'imports', repo, count(*) FROM fx_imports WHERE file_id NOT IN (SELECT file_id FROM gone) GROUP BY repo
    UNION ALL SELECT 'refs', repo, count(*) FROM fx_refs WHERE file_id NOT IN (SELECT file_id FROM gone) GROUP BY repo""",
)
def prune_stale(spark, sf):
    """Files of documents labelled toxic are gone; what is left of every fact table."""
    c = fx.corpus(spark, sf)
    gone = c.files.join(fx.read(spark, sf, "labels").where("toxic = 1"), F.col("file_id") == F.col("doc_id"))
    left = incremental.prune_stale(c, gone)
    parts = [
        getattr(left, fact).groupBy("repo").agg(F.count("*").alias("n")).select(F.lit(fact).alias("fact"), "repo", "n")
        for fact in ("files", "lines", "symbols", "imports", "refs")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_LANG_OF_REPO = {"repo_en": "python", "repo_de": "go", "repo_fr": "markdown", "repo_es": "java"}


@query(
    "refresh_stats",
    f"""
    , lang AS (SELECT f.repo, f.path, m.l AS language, f.n_lines, f.file_id FROM fx_files f JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in _LANG_OF_REPO.items())}) AS m(r, l) ON m.r = f.repo),
    r AS (SELECT o.repo, o.status, coalesce(l.language IN ('python', 'go', 'java'), false) AS ok, coalesce(l.n_lines = 1, false) AS pe,
                 coalesce(s.n, 0) AS n, coalesce(s.n, 0) = 0 AND l.path IS NOT NULL AND coalesce(l.n_lines, 0) <> 1 AS we
          FROM ox_status o LEFT JOIN lang l ON l.repo = o.repo AND l.path = o.path
          LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_symbols GROUP BY 1) s ON s.file_id = l.file_id),
    d AS (SELECT *, ok AND status IN ('new', 'changed') AS dirty FROM r),
    t AS (SELECT repo, count(*) FILTER (dirty AND NOT pe AND NOT we) AS indexed, count(*) FILTER (ok AND status = 'unchanged') AS unchanged,
      count(*) FILTER (status <> 'stale' AND NOT ok) AS unsupported, count(*) FILTER (dirty AND pe) AS parse_errors,
      count(*) FILTER (dirty AND we AND NOT pe) AS write_errors, CAST(coalesce(sum(n) FILTER (dirty AND NOT pe AND NOT we), 0) AS BIGINT) AS symbols_found,
      count(*) FILTER (status = 'stale') AS stale_removed FROM d GROUP BY repo)
    SELECT *, parse_errors + write_errors AS errors, indexed + stale_removed AS refreshed FROM t""",
)
def refresh_stats(spark, sf):
    """One-line files play parse failures, files without definitions write failures."""
    c = fx.corpus(spark, sf)
    lang = F.lit("")
    for repo, name in _LANG_OF_REPO.items():
        lang = F.when(F.col("repo") == repo, name).otherwise(lang)
    per_file = c.symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    files = c.files.join(per_file, "file_id", "left").na.fill(0, ["n"])
    stage = F.when(F.col("n_lines") == 1, "parse").when(F.col("n") == 0, "write")
    errors = files.select("repo", "path", stage.alias("stage")).where("stage IS NOT NULL")
    return incremental.refresh_stats(
        classify_changes(spark, sf), c.files.select("repo", "path", lang.alias("language")),
        files.select("repo", "path", "n"), errors,
    )


@query(
    "latest_changes",
    """SELECT repo, path, arg_max(op, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS op,
       arg_max(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_id, count(*) AS events
       FROM (SELECT repo, path, op, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id FROM fx_changes) x GROUP BY repo, path""",
)
def latest_changes(spark, sf):
    return incremental.latest_changes(fx.changes(spark, sf))


# ---------------------------------------------------------------- bundles and checks

view(
    "ox_impact20",
    """SELECT repo, target, string_agg(depth || ':' || symbol || ':' || rel_path || ':' || line || ':' || caller, ',' ORDER BY depth, symbol, rel_path, line, caller) AS impact
       FROM ox_impact_levels WHERE rank <= 20 GROUP BY repo, target""",
)
view("ox_refs20", """SELECT repo, target, string_agg(rel_path || ':' || line || ':' || ord, ',' ORDER BY rel_path, line, ord) AS refs
     FROM ox_refs50 WHERE rank <= 20 GROUP BY repo, target""")
view(
    "ox_members",
    """SELECT file_id, parent, string_agg(name || ':' || kind, ',' ORDER BY start_line, symbol_id) AS members FROM
       (SELECT *, row_number() OVER (PARTITION BY file_id, parent ORDER BY start_line, symbol_id) AS rn FROM fx_symbols WHERE parent <> '') x
       WHERE rn <= 50 GROUP BY file_id, parent""",
)
view("ox_source", """SELECT s.symbol_id, string_agg(l.text, chr(10) ORDER BY l.line) AS source FROM fx_symbols s
     JOIN fx_lines l ON l.file_id = s.file_id AND l.line BETWEEN s.start_line AND s.end_line GROUP BY s.symbol_id""")


@query(
    "investigate",
    """SELECT b.repo, b.target, b.symbol_id, b.name, b.kind, CASE b.kind WHEN 'class' THEN 'type' ELSE b.kind END AS investigate_kind,
       s.source, b.also, b.total_found, b.fuzzy, coalesce(r.refs, '') AS refs,
       CASE WHEN b.kind = 'function' THEN coalesce(i.impact, '') ELSE '' END AS impact,
       CASE WHEN b.kind = 'class' THEN coalesce(m.members, '') ELSE '' END AS members
       FROM ox_best b JOIN ox_source s ON s.symbol_id = b.symbol_id LEFT JOIN ox_refs20 r ON r.repo = b.repo AND r.target = b.name
       LEFT JOIN ox_impact20 i ON i.repo = b.repo AND i.target = b.name LEFT JOIN ox_members m ON m.file_id = b.file_id AND m.parent = b.name""",
)
def investigate(spark, sf):
    found = bundle.investigate(fx.corpus(spark, sf), impact_edges(spark, sf), fx.targets(spark, sf))
    return found.select(
        "repo", "target", "symbol_id", "name", "kind", "investigate_kind", "source", F.array_join("also", ",").alias("also"),
        "total_found", "fuzzy", joined(F.col("refs"), "rel_path", "line", "ord").alias("refs"),
        joined(F.col("impact"), "depth", "symbol", "rel_path", "line", "caller").alias("impact"),
        joined(F.col("members"), "name", "kind").alias("members"),
    )


@query(
    "investigate_strict",
    """
    , wanted AS (SELECT repo, target, '' AS file_hint FROM fx_targets UNION SELECT repo, name, min(rel_path) FROM ox_symfile GROUP BY ALL
        UNION SELECT DISTINCT repo, name, 'no such path' FROM fx_symbols),
    hits AS (SELECT w.*, s.symbol_id, s.file_id, s.kind, s.rel_path, s.start_line, contains(s.rel_path, w.file_hint) AS fits
        FROM wanted w JOIN ox_symfile s ON s.repo = w.repo AND s.name = w.target),
    stats AS (SELECT repo, target, file_hint, count(*) AS n, count_if(fits) AS n_fit FROM hits GROUP BY ALL),
    rest AS (SELECT h.*, CASE WHEN n_fit > 0 THEN n_fit ELSE n END AS matches,
        row_number() OVER (PARTITION BY repo, target, file_hint ORDER BY rel_path, start_line, symbol_id) AS rn
        FROM hits h JOIN stats USING (repo, target, file_hint) WHERE fits OR n_fit = 0),
    told AS (SELECT repo, target, file_hint, any_value(matches) AS matches, arg_min(symbol_id, rn) AS symbol_id, arg_min(file_id, rn) AS file_id,
        arg_min(kind, rn) AS kind, string_agg(rel_path || ':' || start_line, ',' ORDER BY rn) FILTER (rn <= 100) AS places FROM rest GROUP BY ALL)
    SELECT w.repo, w.target, w.file_hint, coalesce(t.matches, 0) AS matches,
      CASE WHEN t.matches IS NULL THEN 'not found' WHEN t.matches = 1 THEN 'found' ELSE 'ambiguous' END AS status,
      CASE WHEN t.matches > 1 THEN t.places ELSE '' END AS also, s.symbol_id, s.source, coalesce(r.refs, '') AS refs,
      CASE WHEN t.kind = 'function' THEN coalesce(i.impact, '') ELSE '' END AS impact,
      CASE WHEN t.kind = 'class' THEN coalesce(m.members, '') ELSE '' END AS members
    FROM wanted w LEFT JOIN told t ON t.repo = w.repo AND t.target = w.target AND t.file_hint = w.file_hint
    LEFT JOIN ox_source s ON t.matches = 1 AND s.symbol_id = t.symbol_id
    LEFT JOIN ox_refs20 r ON t.matches = 1 AND r.repo = t.repo AND r.target = t.target
    LEFT JOIN ox_impact20 i ON t.matches = 1 AND i.repo = t.repo AND i.target = t.target
    LEFT JOIN ox_members m ON t.matches = 1 AND m.file_id = t.file_id AND m.parent = t.target""",
)
def investigate_strict(spark, sf):
    """All targets as they are, and every name with a path that holds it and with one that none has."""
    c = fx.corpus(spark, sf)
    held = c.symbols.join(c.files.select("file_id", "rel_path"), "file_id").groupBy("repo", F.col("name").alias("target")).agg(
        F.min("rel_path").alias("file_hint"))
    targets = (
        fx.targets(spark, sf).select("repo", "target", F.lit("").alias("file_hint")).unionByName(held)
        .unionByName(held.withColumn("file_hint", F.lit("no such path")))
    )
    found = bundle.investigate_strict(c, impact_edges(spark, sf), targets)
    return found.select(
        "repo", "target", "file_hint", "matches", "status", F.coalesce(F.array_join("also", ","), F.lit("")).alias("also"), "symbol_id",
        "source", joined(F.col("refs"), "rel_path", "line", "ord").alias("refs"),
        joined(F.col("impact"), "depth", "symbol", "rel_path", "line", "caller").alias("impact"),
        joined(F.col("members"), "name", "kind").alias("members"),
    )


@query(
    "symbol_context",
    """
    , m AS (SELECT repo, name AS target, count(*) AS matches FROM fx_symbols GROUP BY ALL),
    u AS (SELECT m.*, s.symbol_id, s.file_id, s.start_line, s.end_line FROM m JOIN fx_symbols s ON s.repo = m.repo AND s.name = m.target WHERE matches = 1),
    t AS (SELECT symbol_id, string_agg(rel_path || ':' || start_line || ':' || name || ':' || kind, ',' ORDER BY rel_path, start_line, name, kind) AS type_refs
          FROM (SELECT DISTINCT u.symbol_id, d.rel_path, d.start_line, d.name, d.kind FROM u JOIN fx_refs r ON r.file_id = u.file_id
                AND r.line BETWEEN u.start_line AND u.end_line JOIN ox_symfile d ON d.repo = r.repo AND d.name = r.name AND d.kind = 'class') x GROUP BY symbol_id),
    i AS (SELECT file_id, string_agg(raw_path, ',' ORDER BY raw_path) AS imports FROM fx_imports GROUP BY file_id)
    SELECT m.repo, m.target, m.matches, m.matches > 1 AS ambiguous, u.symbol_id, s.source, coalesce(t.type_refs, '') AS type_refs,
      coalesce(CASE WHEN m.matches = 1 THEN r.refs END, '') AS callers, coalesce(i.imports, '') AS imports
    FROM m LEFT JOIN u ON u.repo = m.repo AND u.target = m.target LEFT JOIN ox_source s ON s.symbol_id = u.symbol_id
    LEFT JOIN t ON t.symbol_id = u.symbol_id LEFT JOIN ox_refs20 r ON r.repo = m.repo AND r.target = m.target LEFT JOIN i ON i.file_id = u.file_id""",
)
def symbol_context(spark, sf):
    found = bundle.symbol_context(fx.corpus(spark, sf), names(spark, sf))
    return found.select(
        "repo", "target", "matches", "ambiguous", "symbol_id", "source",
        joined(F.col("type_refs"), "rel_path", "start_line", "name", "kind").alias("type_refs"),
        joined(F.col("callers"), "rel_path", "line", "ord").alias("callers"),
        F.coalesce(F.array_join("imports", ","), F.lit("")).alias("imports"),
    )


_BEST_NAMED = """
    , best AS (SELECT repo, name, symbol_id, row_number() OVER (PARTITION BY repo, name ORDER BY
        length(rel_path) - length(replace(rel_path, '/', '')), CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'variable' THEN 4 ELSE 0 END,
        length(rel_path), rel_path, start_line, symbol_id) AS rn FROM ox_symfile)"""
_CHECKS = """    SELECT s.repo, s.name, 'search' AS "check", bool_or(contains(rel_path, 'main_d')) AND bool_or(kind = 'class') AS passed
    FROM (SELECT *, row_number() OVER (PARTITION BY repo, name ORDER BY rel_path, start_line, symbol_id) AS rn FROM ox_symfile) s WHERE rn <= 100 GROUP BY s.repo, s.name
    UNION ALL SELECT b.repo, b.name, 'show', contains(s.source, b.name) FROM best b JOIN ox_source s ON s.symbol_id = b.symbol_id WHERE b.rn = 1
    UNION ALL SELECT t.repo, t.target, 'refs', EXISTS (SELECT 1 FROM fx_refs r WHERE r.repo = t.repo AND r.name = t.target) FROM fx_names t"""


@query("ground_truth_check", f"{_BEST_NAMED}\n{_CHECKS}")
def ground_truth_check(spark, sf):
    expected = names(spark, sf).select(
        "repo", F.col("target").alias("name"), F.lit("main_d").alias("file_contains"), F.lit("class").alias("kind"),
        F.col("target").alias("show_contains"), F.lit(1).alias("refs_min"),
    )
    return quality.ground_truth_check(fx.corpus(spark, sf), expected)


@query(
    "ground_truth_totals",
    f"""{_BEST_NAMED}, checks AS ({_CHECKS})
    SELECT "check", count(*) AS total, count_if(passed) AS passed FROM checks GROUP BY ALL""",
)
def ground_truth_totals(spark, sf):
    return quality.check_totals(ground_truth_check(spark, sf))
