"""Registered queries: sources, filters, lookups, functions, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.constants import EXTENSION_LANGUAGE, FILENAME_LANGUAGE, SKIP_DIRECTORIES, SUPPORTED_LANGUAGES, TRACE_NOISE
from corpusgraph.functions import paths, text
from corpusgraph.operators import edges, lookup, ranking, search
from corpusgraph.plans import fixtures as fx
from corpusgraph.plans.registry import query, view
from corpusgraph.sources import ignore, tree


def names(spark: SparkSession, sf: str) -> DataFrame:
    """Every defined name of every repository as lookup target."""
    return fx.corpus(spark, sf).symbols.select("repo", F.col("name").alias("target")).distinct()


view("fx_names", "SELECT DISTINCT repo, name AS target FROM fx_symbols")


def quoted_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def values_rows(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


# ---------------------------------------------------------------- sources


@query("scan_source_tree")
def scan_source_tree(spark, sf):
    """The folder of the given tables is the tree that is listed."""
    return tree.list_tree(spark, sf, "testdata").drop("failed")


@query("file_hashes", "SELECT 'repo_' || lang AS repo, doc_id AS file_id, sha256(text) AS hash FROM documents")
def file_hashes(spark, sf):
    return tree.with_hash(fx.contents(spark, sf)).select("repo", "file_id", "hash")


@query("explode_lines", "SELECT repo, file_id, line, text FROM fx_lines")
def explode_lines(spark, sf):
    return tree.explode_lines(fx.contents(spark, sf))


@query("all_files", "SELECT repo, path, rel_path FROM fx_files")
def all_files(spark, sf):
    return lookup.all_files(fx.corpus(spark, sf))


@query("all_files_of_language", "SELECT repo, path, rel_path FROM fx_files WHERE language = 'src3'")
def all_files_of_language(spark, sf):
    return lookup.all_files(fx.corpus(spark, sf), "src3")


# ---------------------------------------------------------------- path filters


def _named_paths(spark, sf):
    """Every file under every known extension, special name, and an unknown one."""
    endings = [*EXTENSION_LANGUAGE, *[f"/{n}" for n in FILENAME_LANGUAGE], ".GO", "/.env", ""]
    stems = F.regexp_replace("rel_path", "[.][a-z]+$", "")
    return fx.corpus(spark, sf).files.select(
        "repo", F.explode(F.transform(F.array(*[F.lit(e) for e in endings]), lambda e: F.concat(stems, e))).alias("rel_path")
    )


view(
    "ox_named_paths",
    "SELECT repo, regexp_replace(rel_path, '[.][a-z]+$', '') || unnest(["
    + quoted_list([*EXTENSION_LANGUAGE, *[f"/{n}" for n in FILENAME_LANGUAGE], ".GO", "/.env", ""])
    + "]) AS rel_path FROM fx_files",
)
view(
    "ox_languages",
    "SELECT p.repo, p.rel_path, coalesce(e.l, n.l, '') AS language FROM ox_named_paths p "
    f"LEFT JOIN (VALUES {values_rows(EXTENSION_LANGUAGE)}) AS e(x, l) ON e.x = regexp_extract(p.rel_path, '([.][^./]*)$', 1) "
    f"LEFT JOIN (VALUES {values_rows(FILENAME_LANGUAGE)}) AS n(x, l) ON n.x = regexp_extract(p.rel_path, '([^/]*)$', 1)",
)


@query("detect_language", "SELECT repo, rel_path, language FROM ox_languages")
def detect_language(spark, sf):
    return _named_paths(spark, sf).withColumn("language", paths.detect_language("rel_path"))


@query(
    "supported_files",
    f"SELECT repo, rel_path, language FROM ox_languages WHERE language IN ({quoted_list(SUPPORTED_LANGUAGES)})",
)
def supported_files(spark, sf):
    return detect_language(spark, sf).where(paths.is_supported("language"))


_FOLDERS = ["", "lib/", "node_modules/", "a/.git/", "x/target/y/", ".hidden/", "builds/", "a.build/", "dist/.env/"]


@query(
    "skip_dirs",
    "SELECT repo, rel_path FROM (SELECT repo, unnest([" + quoted_list(_FOLDERS) + "]) || unnest_path AS rel_path FROM "
    "(SELECT repo, unnest([rel_path, '.env', rel_path || '.d/vendor']) AS unnest_path FROM fx_files) x) y "
    "WHERE NOT regexp_matches(rel_path, '(^|/)([.][^/]+|"
    + "|".join(d for d in SKIP_DIRECTORIES if not d.startswith("."))
    + ")/')",
)
def skip_dirs(spark, sf):
    tails = F.array(F.col("rel_path"), F.lit(".env"), F.concat("rel_path", F.lit(".d/vendor")))
    folders = F.array(*[F.lit(f) for f in _FOLDERS])
    return (
        fx.corpus(spark, sf).files.select("repo", F.explode(tails).alias("tail"))
        .select("repo", F.explode(F.transform(folders, lambda f: F.concat(f, F.col("tail")))).alias("rel_path"))
        .where(~paths.in_skipped_directory("rel_path"))
    )


# The oracle's own translation of the fixture rules, written by hand.
_RULE_REGEX = [
    (1, "^(.*/)?src1$"), (2, "^(.*/)?[^/]*[.]fr$"), (3, "^(.*/)?src2/[^/]*[.]fr$"),
    (4, "^(.*/)?([^/]+/)*pkg3/[^/]*[.]en$"), (5, "^(.*/)?main_d4[.]en$"), (6, "^(.*/)?[^/]*[.]en$"),
    (7, "^(.*/)?[dx][^/][.]de$"), (8, "^pkg[^/]*(/.*)?$"),
]


@query(
    "ignore_rules",
    f"""
    , rx AS (SELECT r.*, x.regex FROM fx_rules r JOIN (VALUES {", ".join(f"({o}, '{r}')" for o, r in _RULE_REGEX)}) AS x(o, regex) ON x.o = r.ord),
    nodes AS (SELECT repo, rel_path, array_to_string(parts[1:i], '/') AS node, i < len(parts) AS is_dir
              FROM (SELECT repo, rel_path, string_split(rel_path, '/') AS parts, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS i FROM fx_files) x),
    hits AS (SELECT n.repo, n.rel_path, n.node, arg_max(r.negated, r.ord) AS negated FROM nodes n JOIN rx r ON r.repo = n.repo
             AND (r.base_dir = '' OR starts_with(n.node, r.base_dir || '/')) AND (NOT r.dir_only OR n.is_dir)
             AND regexp_matches(CASE WHEN r.base_dir = '' THEN n.node ELSE substr(n.node, length(r.base_dir) + 2) END, r.regex)
             GROUP BY n.repo, n.rel_path, n.node)
    SELECT f.repo, f.rel_path, coalesce(h.ignored, false) AS ignored FROM fx_files f
    LEFT JOIN (SELECT repo, rel_path, bool_or(NOT negated) AS ignored FROM hits GROUP BY repo, rel_path) h
    ON h.repo = f.repo AND h.rel_path = f.rel_path""",
)
def ignore_rules(spark, sf):
    files = fx.corpus(spark, sf).files.select("repo", "rel_path")
    return ignore.ignored_files(files, fx.ignore_rules(spark, sf))


# ---------------------------------------------------------------- functions


@query(
    "path_parts",
    """SELECT repo, rel_path, regexp_extract(rel_path, '([^/]*)$', 1) AS base,
       CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '.' END AS dir,
       regexp_extract(rel_path, '([.][^./]*)$', 1) AS ext,
       regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '[.][^.]*$', '') AS stem,
       CAST(len(string_split(rel_path, '/')) - 1 AS INT) AS slashes FROM fx_files""",
)
def path_parts(spark, sf):
    return fx.corpus(spark, sf).files.select(
        "repo", "rel_path", paths.base_name("rel_path").alias("base"), paths.dir_name("rel_path").alias("dir"),
        paths.extension("rel_path").alias("ext"), paths.stem("rel_path").alias("stem"),
        paths.depth_of("rel_path").alias("slashes"),
    )


@query(
    "dotted_paths",
    """SELECT repo, rel_path, v AS dotted FROM (SELECT repo, rel_path, unnest(list_distinct([d, replace(d, '.go', ''), replace(d, '.py', '')])) AS v
       FROM (SELECT repo, rel_path, replace(regexp_replace(rel_path, '[.]([a-z]+)$', '.go.\\1.py'), '/', '.') AS d FROM fx_files) x) y""",
)
def dotted_paths(spark, sf):
    renamed = F.regexp_replace("rel_path", "[.]([a-z]+)$", ".go.$1.py")
    return fx.corpus(spark, sf).files.select("repo", "rel_path", F.explode(paths.dotted_variants(renamed)).alias("dotted"))


@query(
    "predicates",
    """SELECT repo, symbol_id, contains(lower(name), 'tion') AS has, starts_with(lower(name), 'th') AS starts,
       lower(name) = 'thtion' AS same, regexp_matches(name, '^[A-Z]') AS capital FROM fx_symbols""",
)
def predicates(spark, sf):
    return fx.corpus(spark, sf).symbols.select(
        "repo", "symbol_id", F.contains(F.lower("name"), F.lit("tion")).alias("has"),
        F.startswith(F.lower("name"), F.lit("th")).alias("starts"),
        text.equal_ignoring_case(F.col("name"), F.lit("THTION")).alias("same"),
        text.starts_with_capital("name").alias("capital"),
    )


view(
    "ox_tokens",
    """SELECT repo, symbol_id, 0 AS col, CAST(unnest(range(0, len(a))) AS INT) AS pos, unnest(a) AS token
       FROM (SELECT repo, symbol_id, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS a FROM fx_symbols) x
       UNION ALL
       SELECT repo, symbol_id, 1, CAST(unnest(range(0, len(a))) AS INT), unnest(a)
       FROM (SELECT repo, symbol_id, regexp_extract_all(lower(kind), '[\\p{L}\\p{N}]+') AS a FROM fx_symbols) y""",
)


@query("symbol_tokens", "SELECT repo, symbol_id, col, pos, token FROM ox_tokens")
def symbol_tokens(spark, sf):
    return search.symbol_tokens(fx.corpus(spark, sf).symbols)


_CALL_FORMS = ["a.b::%", "p->%<int>", "ns::x.%", "%(x)", "std::%", "%<T>"]


@query(
    "normalize_call_name",
    f"""
    , forms AS (SELECT DISTINCT repo, name, form, replace(form, '%', name) AS call, lang FROM fx_refs,
        (SELECT unnest([{quoted_list(_CALL_FORMS)}]) AS form) f, (SELECT unnest(['cpp', 'c', 'rust']) AS lang) l),
    cut AS (SELECT *, CASE WHEN lang = 'rust' THEN regexp_replace(call, '^.*[.]', '') ELSE regexp_replace(call, '^.*([.]|->|::)', '') END AS n FROM forms)
    SELECT repo, call, lang, CASE WHEN regexp_matches(m, '[()]') THEN '' ELSE m END AS name FROM
    (SELECT *, CASE WHEN lang = 'cpp' AND ends_with(n, '>') THEN regexp_replace(n, '^([^<]+)<.*$', '\\1') ELSE n END AS m FROM cut) x""",
)
def normalize_call_name(spark, sf):
    forms = F.array(*[F.lit(f) for f in _CALL_FORMS])
    langs = F.array(F.lit("cpp"), F.lit("c"), F.lit("rust"))
    return (
        fx.corpus(spark, sf).refs.select("repo", "name").distinct()
        .select("repo", "name", F.explode(forms).alias("form"))
        .select("repo", F.replace("form", F.lit("%"), "name").alias("call"), F.explode(langs).alias("lang"))
        .withColumn("name", text.normalize_call_name("call", "lang"))
    )


@query(
    "project_callees",
    f"""SELECT repo, name, count(*) AS calls FROM (SELECT repo, unnest([name, substr(name, 1, 2), substr(name, 1, 3), 'Println']) AS name FROM fx_refs) x
        WHERE name NOT IN ({quoted_list(TRACE_NOISE)}) AND strlen(name) > 2 GROUP BY repo, name""",
)
def project_callees(spark, sf):
    more = F.array(F.col("name"), F.substring("name", 1, 2), F.substring("name", 1, 3), F.lit("Println"))
    refs = fx.corpus(spark, sf).refs.select("repo", F.explode(more).alias("name"))
    return edges.project_callees(refs).groupBy("repo", "name").agg(F.count("*").alias("calls"))


@query(
    "signature_head",
    """SELECT symbol_id, CASE WHEN contains(signature, chr(10)) THEN string_split(signature, chr(10))[1] || ' ...' ELSE signature END AS head
       FROM fx_symbols""",
)
def signature_head(spark, sf):
    return fx.corpus(spark, sf).symbols.select("symbol_id", text.signature_head("signature").alias("head"))


@query(
    "symbol_ids",
    """SELECT s.symbol_id, f.rel_path || ':' || s.language || ':' || s.kind || ':' || s.name || ':' || s.start_line AS identity
       FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id""",
)
def symbol_ids(spark, sf):
    c = fx.corpus(spark, sf)
    return c.symbols.join(c.files.select("file_id", "rel_path"), "file_id").select(
        "symbol_id", text.symbol_identity().alias("identity")
    )


# ---------------------------------------------------------------- lookups

_SYM = "s.repo, t.target, s.symbol_id, s.name, s.kind, f.rel_path, s.start_line"
view("ox_symfile", "SELECT s.*, f.path, f.rel_path FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id")


def _ranked(columns: str, source: str, keys: str, order: str, k: int) -> str:
    return (
        f"SELECT {columns}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INT) AS rank "
        f"FROM ({source}) x) y WHERE rank <= {k}"
    )


_SYMBOL_COLUMNS = ["repo", "target", "symbol_id", "name", "kind", "rel_path", "start_line", "rank"]


@query("symbols_exact", _ranked(
    "repo, target, symbol_id, name, kind, rel_path, start_line",
    "SELECT s.*, t.target FROM ox_symfile s JOIN fx_names t ON t.repo = s.repo AND t.target = s.name",
    "repo, target", "name, rel_path, start_line, symbol_id", 50))
def symbols_exact(spark, sf):
    return lookup.symbols_exact(fx.corpus(spark, sf), names(spark, sf)).select(_SYMBOL_COLUMNS)


@query("symbols_exact_filtered", _ranked(
    "repo, target, symbol_id, name, kind, rel_path, start_line",
    "SELECT s.*, t.target FROM ox_symfile s JOIN fx_names t ON t.repo = s.repo AND t.target = s.name WHERE s.kind = 'class' AND s.language = 'src3'",
    "repo, target", "name, rel_path, start_line, symbol_id", 50))
def symbols_exact_filtered(spark, sf):
    return lookup.symbols_exact(fx.corpus(spark, sf), names(spark, sf), "class", "src3").select(_SYMBOL_COLUMNS)


@query("symbols_ci", _ranked(
    "repo, target, symbol_id, name, kind, rel_path, start_line",
    "SELECT s.*, upper(t.target) AS target FROM ox_symfile s JOIN fx_names t ON t.repo = s.repo AND lower(t.target) = lower(s.name)",
    "repo, target", "name, rel_path, start_line, symbol_id", 50))
def symbols_ci(spark, sf):
    upper = names(spark, sf).withColumn("target", F.upper("target"))
    return lookup.symbols_ci(fx.corpus(spark, sf), upper).select(_SYMBOL_COLUMNS)


@query(
    "file_outline",
    """SELECT repo, rel_path, start_line, end_line, symbol_id, repeat('  ', depth) AS indent, kind, name, depth, signature FROM ox_symfile""",
)
def file_outline(spark, sf):
    return lookup.file_outline(fx.corpus(spark, sf), signatures=True)


@query("child_symbols", _ranked(
    "repo, parent, symbol_id, name, kind, rel_path", "SELECT * FROM ox_symfile WHERE parent <> ''",
    "repo, parent", "start_line, rel_path, symbol_id", 50))
def child_symbols(spark, sf):
    c = fx.corpus(spark, sf)
    parents = c.symbols.select("repo", F.col("parent").alias("target"))
    return lookup.child_symbols(c, parents).select("repo", "parent", "symbol_id", "name", "kind", "rel_path", "rank")


@query("child_symbols_scoped", _ranked(
    "file_id, parent, symbol_id, name, kind, rel_path", "SELECT * FROM ox_symfile WHERE parent <> ''",
    "file_id, parent", "start_line, symbol_id", 50))
def child_symbols_scoped(spark, sf):
    c = fx.corpus(spark, sf)
    return lookup.child_symbols_scoped(c, c.symbols.select("file_id", "parent")).select(
        "file_id", "parent", "symbol_id", "name", "kind", "rel_path", "rank"
    )


@query("file_imports", "SELECT f.repo, f.rel_path, i.raw_path FROM fx_imports i JOIN fx_files f ON f.file_id = i.file_id")
def file_imports(spark, sf):
    return lookup.file_imports(fx.corpus(spark, sf))


_TEXT_HITS = """SELECT l.repo, f.path, f.rel_path, l.line, substr(l.text, 1, 200) AS snippet
    FROM fx_lines l JOIN fx_files f ON f.file_id = l.file_id WHERE contains(l.text, 'tion ')"""


@query("text_search", f"{_TEXT_HITS} ORDER BY f.rel_path, l.line, l.repo LIMIT 50")
def text_search(spark, sf):
    return search.text_search(fx.corpus(spark, sf), "tion ")


@query("text_search_all", f"{_TEXT_HITS} AND f.language = 'src3'")
def text_search_all(spark, sf):
    return search.text_search(fx.corpus(spark, sf), "tion ", "src3", limit=None)


@query(
    "source_slice",
    """SELECT s.symbol_id AS range_id, l.file_id, l.line, l.text FROM fx_symbols s JOIN fx_lines l
       ON l.file_id = s.file_id AND l.line BETWEEN greatest(1, s.start_line - 1) AND s.end_line + 1""",
)
def source_slice(spark, sf):
    c = fx.corpus(spark, sf)
    first, last, _ = lookup.truncated_range(context=1)
    return lookup.source_slice(c, c.symbols.select(
        F.col("symbol_id").alias("range_id"), "file_id", first.alias("first"), last.alias("last")
    ))


@query(
    "type_truncation",
    """SELECT symbol_id, greatest(1, start_line - 2) AS first,
       CASE WHEN kind = 'class' AND n > 60 THEN greatest(1, start_line - 2) + 59 ELSE last_line + 2 END AS last,
       CASE WHEN kind = 'class' AND n > 60 THEN n - 60 ELSE 0 END AS hidden
       FROM (SELECT s.*, f.n_lines AS last_line, f.n_lines - s.start_line + 1 AS n FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id) x""",
)
def type_truncation(spark, sf):
    """Every symbol stretched to the end of its file, so long types occur."""
    c = fx.corpus(spark, sf)
    long = c.symbols.drop("end_line").join(c.files.select("file_id", F.col("n_lines").alias("end_line")), "file_id")
    first, last, hidden = lookup.truncated_range(context=2)
    return long.select("symbol_id", first.alias("first"), last.alias("last"), hidden.alias("hidden"))


view(
    "fx_all_targets",
    """SELECT repo, target FROM fx_targets UNION ALL
       SELECT repo, unnest([path || ':L2-L' || n_lines, rel_path || ':' || n_lines, rel_path]) FROM fx_files""",
)


@query(
    "parse_targets",
    """
    , cut AS (SELECT repo, target, regexp_extract(target, '^(.+):([^:]*)$', 1) AS l, regexp_extract(target, '^(.+):([^:]*)$', 2) AS r FROM fx_all_targets),
    kinds AS (SELECT *, contains(l, '/') AS path_left, regexp_matches(r, '^L?[0-9]+(-.*)?$') AS is_range, contains(target, '/') AS slash FROM cut),
    read AS (SELECT *, CASE WHEN path_left AND is_range THEN 'lines' WHEN path_left THEN 'symbol' WHEN slash THEN 'path' ELSE 'name' END AS form FROM kinds)
    SELECT repo, target, CASE form WHEN 'lines' THEN l WHEN 'symbol' THEN l WHEN 'path' THEN target ELSE '' END AS file,
      CASE WHEN form = 'symbol' THEN r WHEN form = 'name' THEN (CASE WHEN contains(target, '.') THEN regexp_replace(target, '^[^.]*[.]', '') ELSE target END) ELSE '' END AS symbol,
      CASE WHEN form = 'lines' THEN CAST(regexp_extract(r, '^L?([0-9]+)', 1) AS INT) ELSE 0 END AS start_line,
      CASE WHEN form = 'lines' THEN CAST(regexp_extract(r, 'L?([0-9]+)$', 1) AS INT) ELSE 0 END AS end_line,
      form IN ('lines', 'path') AS is_path,
      CASE WHEN form = 'name' AND contains(target, '.') THEN string_split(target, '.')[1] ELSE '' END AS parent_hint
    FROM read""",
)
def parse_targets(spark, sf):
    c = fx.corpus(spark, sf)
    n = F.col("n_lines").cast("string")
    forms = F.array(
        F.concat("path", F.lit(":L2-L"), n), F.concat("rel_path", F.lit(":"), n), F.col("rel_path")
    )
    lined = c.files.select("repo", F.explode(forms).alias("target"))
    return lookup.parse_targets(fx.targets(spark, sf).unionByName(lined))


@query(
    "show_lines",
    """
    , asked AS (SELECT repo, file_id, rel_path, n_lines, unnest([
        {'target': path || ':L2-L' || n_lines, 'lo': 2, 'hi': n_lines}, {'target': rel_path || ':' || n_lines, 'lo': n_lines, 'hi': n_lines},
        {'target': rel_path, 'lo': 0, 'hi': 0}, {'target': rel_path || ':3-L900000000', 'lo': 3, 'hi': 900000000},
        {'target': path || ':9-4', 'lo': 9, 'hi': 4}]) AS a FROM fx_files)
    SELECT x.repo, a.target AS target, x.rel_path, l.line, l.text FROM asked x JOIN fx_lines l ON l.file_id = x.file_id
      AND (a.lo = 0 OR l.line BETWEEN greatest(1, a.lo - 1) AND a.hi + 1)
    WHERE contains(a.target, '/')""",
)
def show_lines(spark, sf):
    """Ranges of every file under both of its names, whole files, ranges beyond the end and reversed ones. A name
    without a slash reads as a symbol, so it shows nothing."""
    c = fx.corpus(spark, sf)
    n = F.col("n_lines").cast("string")
    forms = F.array(
        F.concat("path", F.lit(":L2-L"), n), F.concat("rel_path", F.lit(":"), n), F.col("rel_path"),
        F.concat("rel_path", F.lit(":3-L900000000")), F.concat("path", F.lit(":9-4")), F.concat(F.lit("no/such/"), "rel_path"),
    )
    asked = c.files.select("repo", F.explode(forms).alias("target"))
    return lookup.show_lines(c, asked.unionByName(fx.targets(spark, sf)), context=1)


_REF_SITES = """SELECT r.*, f.rel_path, t.target FROM fx_refs r JOIN fx_names t ON t.repo = r.repo AND t.target = r.name
    JOIN fx_files f ON f.file_id = r.file_id"""
view("ox_refs50", _ranked("repo, target, file_id, rel_path, line, ord", _REF_SITES, "repo, target", "rel_path, line, ord", 50))


@query("find_references", "SELECT repo, target, rel_path, line, ord, rank FROM ox_refs50")
def find_references(spark, sf):
    return lookup.find_references(fx.corpus(spark, sf), names(spark, sf)).select("repo", "target", "rel_path", "line", "ord", "rank")


@query("find_references_all", f"SELECT repo, target, rel_path, line, ord FROM ({_REF_SITES}) x")
def find_references_all(spark, sf):
    return lookup.find_references(fx.corpus(spark, sf), names(spark, sf), None).select("repo", "target", "rel_path", "line", "ord")


@query("refs_batch_topk", "SELECT repo, target, rel_path, line, ord, rank FROM ox_refs50 WHERE rank <= 5")
def refs_batch_topk(spark, sf):
    return lookup.find_references(fx.corpus(spark, sf), names(spark, sf), 5).select("repo", "target", "rel_path", "line", "ord", "rank")


_RANK_ORDER = """CAST(length(rel_path) - length(replace(rel_path, '/', '')) AS INT),
    CASE kind WHEN 'class' THEN 0 WHEN 'function' THEN 1 WHEN 'variable' THEN 4 ELSE 0 END, length(rel_path), rel_path, start_line, symbol_id"""


@query("rank_symbols", _ranked(
    "repo, target, symbol_id, name, kind, rel_path, start_line",
    "SELECT s.*, t.target FROM ox_symfile s JOIN fx_names t ON t.repo = s.repo AND t.target = s.name",
    "repo, target", _RANK_ORDER, 20))
def rank_symbols(spark, sf):
    c = fx.corpus(spark, sf)
    candidates = c.symbols.withColumn("target", F.col("name")).join(c.files.select("file_id", "rel_path"), "file_id")
    return ranking.rank_symbols(candidates, 20).select(_SYMBOL_COLUMNS)


@query("ambiguous_symbols", """SELECT e.repo, e.target, e.symbol_id, e.rel_path, e.start_line, e.rank, n.matches FROM (""" + _ranked(
    "repo, target, symbol_id, rel_path, start_line", "SELECT s.*, s.name AS target FROM ox_symfile s",
    "repo, target", "rel_path, start_line, symbol_id", 100) + """) e
    JOIN (SELECT repo, name, count(*) AS matches FROM fx_symbols GROUP BY repo, name) n ON n.repo = e.repo AND n.name = e.target WHERE n.matches > 1""")
def ambiguous_symbols(spark, sf):
    return lookup.ambiguous_symbols(fx.corpus(spark, sf), names(spark, sf)).select(
        "repo", "target", "symbol_id", "rel_path", "start_line", "rank", "matches"
    )


# ---------------------------------------------------------------- search


def search_queries(spark, sf):
    """A prefix query per distinct five-letter beginning, and two-word queries with a kind."""
    words = F.array(
        F.lower(F.substring("name", 1, 5)), F.concat(F.lit("Class "), F.substring("name", 1, 3)), F.col("name"),
        F.concat("name", F.lit("-fun")),
    )
    return fx.corpus(spark, sf).symbols.select("repo", F.explode(words).alias("query")).distinct()


view(
    "fx_queries",
    """SELECT DISTINCT repo, unnest([lower(substr(name, 1, 5)), 'Class ' || substr(name, 1, 3), name, name || '-fun']) AS query FROM fx_symbols""",
)
view(
    "ox_terms",
    """SELECT repo, query, CAST(unnest(range(0, len(a))) AS INT) AS term_no, unnest(a) AS term, len(a) AS n_terms
       FROM (SELECT repo, query, regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+') AS a FROM fx_queries) x""",
)
view(
    "ox_bm25",
    """
    WITH dict AS (SELECT DISTINCT repo, token FROM ox_tokens),
    terms AS (SELECT t.repo, t.query, t.term_no, t.n_terms, d.token FROM ox_terms t JOIN dict d ON d.repo = t.repo
              AND (CASE WHEN t.term_no = t.n_terms - 1 THEN starts_with(d.token, t.term) ELSE d.token = t.term END)),
    tf AS (SELECT m.repo, m.query, m.n_terms, m.term_no, k.symbol_id, count(*) AS tf FROM terms m
           JOIN ox_tokens k ON k.repo = m.repo AND k.token = m.token GROUP BY ALL),
    df AS (SELECT repo, query, term_no, count(*) AS df FROM tf GROUP BY ALL),
    dl AS (SELECT repo, symbol_id, count(*) AS dl FROM ox_tokens GROUP BY ALL),
    st AS (SELECT repo, count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl GROUP BY repo)
    SELECT tf.repo, tf.query, tf.symbol_id,
           round(sum(greatest(ln((st.n - df.df + 0.5) / (df.df + 0.5)), 0.000001) * tf.tf * 2.2
                     / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))), 6) AS score
    FROM tf JOIN df USING (repo, query, term_no) JOIN dl USING (repo, symbol_id) JOIN st USING (repo)
    GROUP BY tf.repo, tf.query, tf.symbol_id, tf.n_terms HAVING count(*) = tf.n_terms""",
)


@query("bm25_symbols", "SELECT repo, query, symbol_id, score FROM ox_bm25")
def bm25_symbols(spark, sf):
    return search.bm25_symbols(fx.corpus(spark, sf).symbols, search_queries(spark, sf))


view("ox_search", _ranked(
    "repo, query, symbol_id, name, kind, language, rel_path, start_line, tier, score",
    """SELECT s.*, b.query, b.score, CASE WHEN s.name = b.query THEN 0 WHEN starts_with(lower(s.name), lower(b.query)) THEN 1 ELSE 2 END AS tier
       FROM ox_bm25 b JOIN ox_symfile s ON s.repo = b.repo AND s.symbol_id = b.symbol_id""",
    "repo, query", "tier, score DESC, symbol_id", 50))
_SEARCH_COLUMNS = ["repo", "query", "symbol_id", "name", "rel_path", "tier", "score", "rank"]


@query("search_symbols", "SELECT repo, query, symbol_id, name, rel_path, tier, score, rank FROM ox_search")
def search_symbols(spark, sf):
    return search.search_symbols(fx.corpus(spark, sf), search_queries(spark, sf)).select(_SEARCH_COLUMNS)


@query("search_symbols_filtered", _ranked(
    "repo, query, symbol_id, name, rel_path, tier, score",
    """SELECT s.*, b.query, b.score, CASE WHEN s.name = b.query THEN 0 WHEN starts_with(lower(s.name), lower(b.query)) THEN 1 ELSE 2 END AS tier
       FROM ox_bm25 b JOIN ox_symfile s ON s.repo = b.repo AND s.symbol_id = b.symbol_id WHERE s.kind = 'function'""",
    "repo, query", "tier, score DESC, symbol_id", 50))
def search_symbols_filtered(spark, sf):
    return search.search_symbols(fx.corpus(spark, sf), search_queries(spark, sf), kind="function").select(_SEARCH_COLUMNS)


_FLEX = """
    , fold AS (SELECT DISTINCT repo, target, lower(target) AS folded FROM fx_plain_targets),
    ci AS (SELECT t.repo, t.target, 0 AS tier, s.symbol_id, s.name, s.kind, s.rel_path, s.start_line,
                  row_number() OVER (PARTITION BY t.repo, t.target ORDER BY s.name, s.rel_path, s.start_line, s.symbol_id) AS rank
           FROM fold t JOIN ox_symfile s ON s.repo = t.repo AND lower(s.name) = t.folded),
    miss AS (SELECT * FROM fold f WHERE NOT EXISTS (SELECT 1 FROM fx_symbols s WHERE s.repo = f.repo AND lower(s.name) = f.folded)),
    pre AS (SELECT m.repo, m.target, 1 AS tier, q.symbol_id, q.name, q.kind, q.rel_path, q.start_line, q.rank
            FROM miss m JOIN ox_search q ON q.repo = m.repo AND q.query = m.target)
    SELECT repo, target, tier, CAST(rank AS INT) AS rank, symbol_id, name, kind, rel_path, start_line
    FROM (SELECT * FROM ci UNION ALL SELECT * FROM pre) u WHERE rank <= 20"""

view("fx_plain_targets", "SELECT DISTINCT repo, unnest([upper(name), lower(substr(name, 1, 5))]) AS target FROM fx_symbols")


def plain_targets(spark, sf):
    forms = F.array(F.upper("name"), F.lower(F.substring("name", 1, 5)))
    return fx.corpus(spark, sf).symbols.select("repo", F.explode(forms).alias("target")).distinct()


@query("search_flex", _FLEX)
def search_flex(spark, sf):
    return lookup.search_flex(fx.corpus(spark, sf), plain_targets(spark, sf))


# Resolution of every target form of the fixture: readings, exact / any-case / prefix, hints, rank.
view(
    "ox_attempts",
    """
    WITH p AS (SELECT repo, target,
        CASE WHEN contains(regexp_extract(target, '^(.+):([^:]*)$', 1), '/') OR regexp_matches(target, '^main_d[0-9]+[.][a-z]+:') THEN regexp_extract(target, '^(.+):([^:]*)$', 1) ELSE '' END AS file,
        target AS t FROM fx_targets),
    q AS (SELECT repo, target, CASE WHEN file <> '' AND contains(file, '/') THEN file ELSE '' END AS file,
                 CASE WHEN file <> '' AND contains(file, '/') THEN regexp_extract(t, '([^:]*)$', 1) ELSE t END AS symbol FROM p)
    SELECT repo, target, file, symbol AS name, '' AS parent_hint, 0 AS attempt FROM q
    UNION ALL
    SELECT repo, target, file, regexp_replace(symbol, '^[^.]*[.]', ''), string_split(symbol, '.')[1], 1 FROM q
    WHERE file = '' AND contains(symbol, '.') AND string_split(symbol, '.')[1] <> '' AND regexp_replace(symbol, '^[^.]*[.]', '') <> ''""",
)
view(
    "ox_candidates",
    """
    WITH e AS (SELECT a.*, min(attempt) OVER (PARTITION BY repo, target) AS best FROM ox_attempts a
               WHERE EXISTS (SELECT 1 FROM fx_symbols s WHERE s.repo = a.repo AND s.name = a.name)),
    r AS (SELECT a.* FROM ox_attempts a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = a.repo AND e.target = a.target)),
    f AS (SELECT r.*, min(attempt) OVER (PARTITION BY repo, target) AS best FROM r
          WHERE EXISTS (SELECT 1 FROM fx_symbols s WHERE s.repo = r.repo AND lower(s.name) = lower(r.name))),
    l AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.repo = r.repo AND f.target = r.target)),
    lt AS (SELECT l.repo, l.target, l.file, l.parent_hint, l.attempt, l.name AS qname,
                  regexp_extract_all(lower(l.name), '[\\p{L}\\p{N}]+') AS w FROM l),
    tk AS (SELECT repo, symbol_id, list(token) AS toks FROM ox_tokens GROUP BY ALL),
    lp AS (SELECT lt.*, tk.symbol_id, min(attempt) OVER (PARTITION BY lt.repo, lt.target) AS best FROM lt JOIN tk ON tk.repo = lt.repo
           WHERE len(w) > 0 AND len(list_filter(toks, lambda x: starts_with(x, w[-1]))) > 0
           AND len(list_filter(w[1:len(w) - 1], lambda y: NOT list_contains(toks, y))) = 0)
    SELECT s.*, e.target, e.file, e.parent_hint, false AS fuzzy FROM e JOIN ox_symfile s ON s.repo = e.repo AND s.name = e.name WHERE e.attempt = e.best
    UNION ALL
    SELECT s.*, f.target, f.file, f.parent_hint, true FROM f JOIN ox_symfile s ON s.repo = f.repo AND lower(s.name) = lower(f.name) WHERE f.attempt = f.best
    UNION ALL
    SELECT s.*, lp.target, lp.file, lp.parent_hint, true FROM lp JOIN ox_symfile s ON s.symbol_id = lp.symbol_id WHERE lp.attempt = lp.best""",
)
view(
    "ox_hinted",
    """SELECT * FROM (SELECT *, count(*) OVER w AS total_found, max(CASE WHEN fits THEN 1 ELSE 0 END) OVER w AS any_fit
       FROM (SELECT *, CASE WHEN file <> '' THEN contains(rel_path, file)
             WHEN parent_hint <> '' THEN lower(parent) = lower(parent_hint) OR contains(rel_path, parent_hint) ELSE true END AS fits FROM ox_candidates) x
       WINDOW w AS (PARTITION BY repo, target)) y WHERE fits OR total_found = 1 OR any_fit = 0""",
)
view("ox_resolved", _ranked(
    "repo, target, symbol_id, file_id, name, kind, rel_path, start_line, end_line, total_found, fuzzy",
    "SELECT * FROM ox_hinted", "repo, target", _RANK_ORDER, 100))


@query("resolve_hints", "SELECT repo, target, symbol_id, file, parent_hint, total_found FROM ox_hinted")
def resolve_hints(spark, sf):
    found = lookup.candidates_for(fx.corpus(spark, sf), fx.targets(spark, sf))
    return lookup.resolve_hints(found).select("repo", "target", "symbol_id", "file", "parent_hint", "total_found")


@query(
    "flex_resolve",
    "SELECT repo, target, symbol_id, kind, rel_path, start_line, total_found, fuzzy, rank FROM ox_resolved WHERE NOT fuzzy OR rank <= 20",
)
def flex_resolve(spark, sf):
    return lookup.flex_resolve(fx.corpus(spark, sf), fx.targets(spark, sf)).select(
        "repo", "target", "symbol_id", "kind", "rel_path", "start_line", "total_found", "fuzzy", "rank"
    )


@query("flex_resolve_all", "SELECT repo, target, symbol_id, kind, rel_path, start_line, total_found, fuzzy FROM ox_hinted")
def flex_resolve_all(spark, sf):
    return lookup.flex_resolve(fx.corpus(spark, sf), fx.targets(spark, sf), None, None).select(
        "repo", "target", "symbol_id", "kind", "rel_path", "start_line", "total_found", "fuzzy"
    )


view(
    "ox_best",
    """SELECT repo, target, arg_min(symbol_id, rank) AS symbol_id, arg_min(file_id, rank) AS file_id, arg_min(name, rank) AS name,
       arg_min(kind, rank) AS kind, arg_min(rel_path, rank) AS rel_path, arg_min(start_line, rank) AS start_line, arg_min(end_line, rank) AS end_line,
       coalesce(string_agg(CASE WHEN rank > 1 THEN rel_path || ':' || start_line END, ',' ORDER BY rank), '') AS also,
       max(total_found) AS total_found, bool_or(fuzzy) AS fuzzy
       FROM ox_resolved WHERE NOT fuzzy OR rank <= 20 GROUP BY repo, target""",
)


@query("auto_resolve", "SELECT repo, target, symbol_id, name, kind, rel_path, start_line, end_line, also, total_found, fuzzy FROM ox_best")
def auto_resolve(spark, sf):
    return lookup.auto_resolve(fx.corpus(spark, sf), fx.targets(spark, sf)).select(
        "repo", "target", "symbol_id", "name", "kind", "rel_path", "start_line", "end_line",
        F.array_join("also", ",").alias("also"), "total_found", "fuzzy",
    )
