"""Fact tables derived from the driver's text tables, so every operator has a data-sized input.

Each document plays a source file, its language names the repository, its lines are the source
lines; definitions, calls and imports are derived from the words. One repository holds far more
than a third of the files, so skew is part of the fixture. ``FIXTURE_SQL`` states the same
derivations for the DuckDB oracle. All tables are whole: nothing is sampled or filtered down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.corpus import Corpus, LazyCorpus
from corpusgraph.runtime import is_empty, materialise, materialised_once, shared, spread
from corpusgraph.sources.tree import explode_lines, n_lines

# --- fixed values: parsed ignore rules used over every repository -------------
IGNORE_RULES = (
    (1, "", "src1", False, True, False),
    (2, "", "*.fr", False, False, False),
    (3, "", "src2/*.fr", True, False, False),
    (4, "", "**/pkg3/*.en", False, False, False),
    (5, "", "main_d4.en", False, False, True),
    (6, "src4", "*.en", False, False, False),
    (7, "", "[dx]?.de", False, False, False),
    (8, "src5/de", "pkg*/**", False, False, True),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, file_id, path, rel_path, language, content) of every document."""
    rel = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("main_d"), "doc_id", F.lit("."), "lang"))
        .when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("/d"), "doc_id", F.lit("."), "lang"))
        .when(
            F.col("doc_id") % 4 == 2,
            F.concat("source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit("."), "lang"),
        )
        .otherwise(
            F.concat(
                "source", F.lit("/"), "lang", F.lit("/pkg"), F.col("doc_id") % 7,
                F.lit("/d"), "doc_id", F.lit("."), "lang",
            )
        )
    )
    return read(spark, sf_dir, "documents").select(
        F.concat(F.lit("repo_"), "lang").alias("repo"),
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/repo_"), "lang", F.lit("/"), rel).alias("path"),
        rel.alias("rel_path"),
        F.col("source").alias("language"),
        F.col("text").alias("content"),
    )


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, languages, n_lines) of ids that come more than once: the languages of all their files with how many files
    have each, and their lines together. Texts are counted before they meet the ids."""
    ids = read(spark, sf_dir, "documents").groupBy(F.col("doc_id").alias("file_id")).count().where("count > 1").select("file_id")
    ids = materialise(ids, "repeated_ids")
    return (
        _contents(spark, sf_dir).select("file_id", "language", n_lines("content").alias("n_lines")).join(ids, "file_id")
        .groupBy("file_id", "language").agg(F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"))
        .groupBy("file_id").agg(F.collect_list(F.struct("language", "n")).alias("languages"), F.sum("n_lines").alias("n_lines"))
    )


def _repeated_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised_once(spark, sf_dir, "repeated", lambda: _repeated(spark, sf_dir))


def _whole_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with what the facts below take from their file: the ``languages`` of all files of the id and its ``n_lines``.
    Kept with the text, they spare every line and every call a join with its file. Ids that repeat are few or none; they
    are written first, so that the join is planned by their real size. An id of many files has each language once."""
    repeated = _repeated_once(spark, sf_dir)
    found = spread(_contents(spark, sf_dir))
    own = F.when(F.col("file_id").isNull(), 0).otherwise(n_lines("content")).cast("int")
    alone = F.array(F.struct("language", F.lit(1).cast("bigint").alias("n")))
    if is_empty(repeated):
        return found.withColumn("languages", alone).withColumn("n_lines", own)
    found = found.join(repeated, "file_id", "left").withColumn("languages", F.coalesce("languages", alone))
    return materialise(found.withColumn("n_lines", F.coalesce("n_lines", own).cast("int")), "contents")


def _every_language() -> Column:
    """``language`` of each file of the row's id, one row each."""
    return F.explode(F.flatten(F.transform(
        "languages", lambda x: F.array_repeat(x["language"], x["n"].cast("int"))))).alias("language")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read from the documents by every reader unless ids repeat, as are the lines: a copy takes as much disk as they do."""
    return shared(spark, sf_dir, "contents", lambda: _whole_contents(spark, sf_dir))


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, each with the ``languages`` and ``n_lines`` of its file."""
    def build():
        found = explode_lines(contents(spark, sf_dir), ["languages", "n_lines"])
        return found if is_empty(_repeated_once(spark, sf_dir)) else materialise(found, "lines")

    return shared(spark, sf_dir, "lines", build)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_lines(spark, sf_dir).select("repo", "file_id", "line", "text")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents(spark, sf_dir).select(
        "repo", "file_id", "path", "rel_path", "language",
        F.sha2("content", 256).alias("hash"),
        (F.col("file_id") * 1000).alias("mtime_us"),
        F.octet_length("content").cast("bigint").alias("size"),
        "n_lines",
    )


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    pos = ((F.col("line") - 1) % 6).cast("int")
    return (
        _file_lines(spark, sf_dir).where("file_id IS NOT NULL")
        .select("repo", "file_id", "line", "text", "n_lines", "languages", word.alias("w"))
        .where(F.length("w") >= 4)
        .select(
            "repo", "file_id", "line", "text", "n_lines", _every_language(),
            capital(F.col("w")).alias("name"),
            pos.alias("pos"),
            (F.col("line") - pos).alias("block_line"),
        )
    )


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _heads(spark, sf_dir)
    blocks = heads.where("pos = 0").select(
        "file_id", F.col("line").alias("block_line"), F.col("name").alias("block_name")
    )
    is_class, is_function = F.col("pos") == 0, F.col("pos").isin(1, 3)
    # Texts are cut to what a symbol keeps of them before the rows meet their blocks.
    heads = heads.select(
        "repo", "file_id", "line", "n_lines", "language", "name", "pos", "block_line", F.length("text").alias("end_col"),
        F.when(is_class, F.substring("text", 1, 120))
        .when(
            is_function,
            F.concat(
                F.lit("("), F.substring("text", 1, 20), F.lit("\n"),
                F.substring("text", 21, 20), F.lit(")"),
            ),
        )
        .otherwise("").alias("signature"),
    )
    return heads.join(blocks, ["file_id", "block_line"], "left").select(
        "repo",
        (F.col("file_id") * 100000 + F.col("line")).alias("symbol_id"),
        "file_id",
        "name",
        F.when(is_class, "class").when(is_function, "function").otherwise("variable").alias("kind"),
        F.col("line").alias("start_line"),
        F.when(is_class, F.least(F.col("line") + 5, "n_lines"))
        .when(is_function, F.least(F.col("line") + 1, "n_lines"))
        .otherwise(F.col("line")).alias("end_line"),
        F.lit(0).alias("start_col"),
        "end_col",
        F.when(is_class, "").otherwise(F.coalesce("block_name", F.lit(""))).alias("parent"),
        F.when(is_class | F.col("block_name").isNull(), 0).otherwise(1).alias("depth"),
        "signature",
        "language",
    )


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("ord", "w")
    return (
        _file_lines(spark, sf_dir).where("file_id IS NOT NULL")
        .select("repo", "file_id", "line", "text", _every_language())
        .select("repo", "file_id", "line", "language", words)
        .where("ord > 0 AND length(w) >= 6")
        .select("repo", "file_id", "line", "ord", capital(F.col("w")).alias("name"), "language")
    )


def _imports(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """A file imports, per name it mentions or defines, the first file that defines the name.

    The first files are as many as there are names: written, so that they are broadcast if they are few. What a file names
    is then shuffled once, to its file, where names are made distinct."""
    first_def = materialise(
        symbols.join(files.select("file_id", "rel_path"), "file_id")
        .groupBy("repo", "name").agg(F.min("rel_path").alias("target")),
        "first_definitions",
    )
    mentioned = refs.select("repo", "file_id", "name").unionByName(symbols.select("repo", "file_id", "name"))
    named = mentioned.join(first_def.select("repo", "name"), ["repo", "name"], "left_semi").repartition("file_id")
    return (
        named.distinct().join(files.select("file_id", "rel_path", "language"), "file_id")
        .join(first_def, ["repo", "name"])
        .where("target <> rel_path")
        .select(
            "repo",
            "file_id",
            F.when(F.col("file_id") % 2 == 0, F.replace("target", F.lit("/"), F.lit(".")))
            .otherwise(F.regexp_replace("target", "[.][a-z]+$", "")).alias("raw_path"),
            "language",
        )
    )


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    def once(name, build):
        return lambda: materialised_once(spark, sf_dir, name, build)

    c = LazyCorpus(
        files=once("files", lambda: _files(spark, sf_dir)),
        lines=lambda: lines(spark, sf_dir),
        symbols=once("symbols", lambda: _symbols(spark, sf_dir)),
        imports=once("imports", lambda: _imports(c.files, c.symbols, c.refs)),
        refs=once("refs", lambda: _refs(spark, sf_dir)),
    )
    return c


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).files.select("repo", "path", "language", "mtime_us", "size")


def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state: labelled documents existed already, raw pages have gone since."""
    files = corpus(spark, sf_dir).files
    labels = read(spark, sf_dir, "labels")
    kept = files.join(labels, files.file_id == labels.doc_id).select(
        "repo", "path", "language",
        (F.col("mtime_us") - F.when(F.col("quality") == 0, 500).otherwise(0)).alias("mtime_us"),
        (F.col("size") + F.col("toxic")).alias("size"),
    )
    page = F.col("page_id").cast("bigint")
    gone = read(spark, sf_dir, "pages").select(
        F.lit("repo_en").alias("repo"),
        F.concat(F.lit("/gone/page_"), page).alias("path"),
        F.lit("html").alias("language"),
        (page * 1000).alias("mtime_us"),
        F.length("html").cast("bigint").alias("size"),
    )
    return kept.unionByName(gone)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change feed: one event per upsert or delete of a path."""
    return read(spark, sf_dir, "events").select(
        F.lit("events").alias("repo"),
        F.concat(F.lit("/repo/u"), "user_id").alias("path"),
        F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"),
        "ts", "event_id",
    )


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[
        F.struct(
            F.lit(o).alias("ord"), F.lit(b).alias("base_dir"), F.lit(p).alias("pattern"),
            F.lit(n).alias("negated"), F.lit(d).alias("dir_only"), F.lit(a).alias("anchored"),
        )
        for o, b, p, n, d, a in IGNORE_RULES
    ])
    repos = corpus(spark, sf_dir).files.select("repo").distinct()
    return repos.select("repo", F.inline(rules))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unified diff per file: a hunk at every class definition."""
    c = corpus(spark, sf_dir)
    count = (
        F.when(F.col("start_line") % 5 == 0, "").when(F.col("start_line") % 5 == 1, ",0").otherwise(",2")
    )
    hunk = F.concat(
        F.lit("@@ -"), "start_line", F.lit(",3 +"), "start_line", count, F.lit(" @@\n-old\n+"), "name",
        F.lit("\n same\n"),
    )
    hunks = (
        c.symbols.where("kind = 'class'").groupBy("file_id")
        .agg(F.sort_array(F.collect_list(F.struct("start_line", hunk.alias("hunk")))).alias("hunks"))
    )
    head = F.concat(
        F.lit("diff --git a/"), "rel_path", F.lit(" b/"), "rel_path", F.lit("\nindex 1..2 100644\n--- a/"),
        "rel_path", F.lit("\n+++ b/"), "rel_path", F.lit("\n"),
    )
    return c.files.join(hunks, "file_id").select(
        "repo", "file_id", F.concat(head, F.array_join("hunks.hunk", "")).alias("patch")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup batch over every name: plain, file-qualified, parent-qualified, other casing,
    prefix, and one unknown per repository."""
    c = corpus(spark, sf_dir)
    named = c.symbols.join(c.files.select("file_id", "rel_path"), "file_id").groupBy("repo", "name").agg(
        F.max("rel_path").alias("file"), F.max("parent").alias("parent")
    )
    forms = F.array_distinct(F.array(
        F.col("name"),
        F.concat("file", F.lit(":"), "name"),
        F.when(F.col("parent") != "", F.concat("parent", F.lit("."), "name")).otherwise(F.col("name")),
        F.upper("name"),
        F.lower(F.substring("name", 1, 5)),
    ))
    unknown = c.files.select("repo", F.lit("Nosuchname").alias("target")).distinct()
    return named.select("repo", F.explode(forms).alias("target")).distinct().unionByName(unknown)


def old_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of an earlier snapshot, see ``fx_old`` below."""
    from corpusgraph.operators.diffs import symbol_bodies

    labels = read(spark, sf_dir, "labels")
    body = symbol_bodies(corpus(spark, sf_dir))
    return body.join(labels, body.file_id == labels.doc_id).select(
        "repo", "rel_path", "kind", "parent",
        F.when(F.col("toxic") == 1, F.concat("name", F.lit("Old"))).otherwise(F.col("name")).alias("name"),
        "start_line",
        F.when(F.col("quality") == 0, F.concat(F.lit("x"), "body_hash")).otherwise(F.col("body_hash"))
        .alias("body_hash"),
    )


# Source code derived from the documents: three source lines per document line.
SOURCE_LANGUAGE = {"repo_en": "python", "repo_de": "go", "repo_fr": "javascript", "repo_es": "java"}
# language -> (class form, function form, import form); {W} the word, {C} the called name, {L} the line
SOURCE_FORMS = {
    "python": ("class {W}:\n    def m{W}(self):\n        {C}()", 'def {W}():\n    # no({}) {\n    {C}("x(")', "import mod_{L}\n\n"),
    "go": ("type {W} struct {\n\ta int // }\n}", 'func {W}() {\n\t{C}("}")\n}', 'import "mod/{L}"\n\n'),
    "javascript": ("class {W} {\n  m{W}() { return {C}(); } n{W}(a) { }\n}", "function {W}() {\n  {C}('}'); // no()\n}", "import 'mod_{L}';\n\n"),
    "java": ("class {W} {\n  int m{W}(int a) { return {C}(a); } void n{W}() { }\n}", "interface {W} {\n  int m{W}(); /* { */\n}", "import mod.l{L};\n\n"),
}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    language = F.lit("")
    for repo, name in SOURCE_LANGUAGE.items():
        language = F.when(F.col("repo") == repo, name).otherwise(language)
    called = c.refs.groupBy("file_id", "line").agg(F.min_by("name", "ord").alias("called"))
    word = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    parts = c.lines.join(called, ["file_id", "line"], "left").select(
        "repo", "file_id", "line", language.alias("language"),
        F.when(F.length(word) >= 4, capital(word)).alias("W"),
        F.concat(F.lit("Call"), F.coalesce("called", F.lit("Noop"))).alias("C"),
    )

    def filled(form: str) -> Column:
        text = F.lit(form)
        for key, value in (("{W}", F.col("W")), ("{C}", F.col("C")), ("{L}", F.col("line").cast("string"))):
            if key in form:
                text = F.replace(text, F.lit(key), value)
        return text

    snippet = F.lit("")
    for lang, (cls, fun, imp) in SOURCE_FORMS.items():
        one = F.when(F.col("W").isNull(), filled(imp)).when(F.col("line") % 6 == 1, filled(cls)).otherwise(filled(fun))
        snippet = F.when(F.col("language") == lang, one).otherwise(snippet)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", snippet.alias("s")))), lambda x: x["s"]), "\n")
    return (
        parts.groupBy("repo", "file_id", "language").agg(text.alias("content"))
        .join(c.files.select("file_id", "path", "rel_path", "mtime_us"), "file_id")
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised_once(spark, sf_dir, "sources", lambda: _sources(spark, sf_dir))


_PARTS = """
SELECT l.repo, l.file_id, l.line, CASE l.repo WHEN 'repo_en' THEN 'python' WHEN 'repo_de' THEN 'go' WHEN 'repo_fr' THEN 'javascript' ELSE 'java' END AS language,
       CASE WHEN length(regexp_extract(l.text, '^([A-Za-z]+)', 1)) >= 4 THEN
         upper(substr(regexp_extract(l.text, '^([A-Za-z]+)', 1), 1, 1)) || lower(substr(regexp_extract(l.text, '^([A-Za-z]+)', 1), 2)) END AS w,
       'Call' || coalesce(r.called, 'Noop') AS c, l.line % 6 = 1 AS is_class, CAST(3 * (l.line - 1) + 1 AS INT) AS s
FROM fx_lines l LEFT JOIN (SELECT file_id, line, arg_min(name, ord) AS called FROM fx_refs GROUP BY ALL) r ON r.file_id = l.file_id AND r.line = l.line"""

_SRC_SYMBOLS = """
SELECT repo, file_id, language, w AS name, CASE WHEN language = 'go' AND is_class THEN 'struct' WHEN is_class THEN 'class'
       WHEN language = 'java' THEN 'interface' ELSE 'function' END AS kind, s AS start_line, s + 2 AS end_line, '' AS parent, 0 AS depth,
       CASE WHEN language = 'go' AND is_class THEN 'type ' || w || ' struct ' WHEN is_class AND language = 'python' THEN 'class ' || w || ':'
       WHEN is_class THEN 'class ' || w || ' ' WHEN language = 'java' THEN 'interface ' || w || ' ' ELSE '()' END AS signature
FROM fx_parts WHERE w IS NOT NULL
UNION ALL
SELECT repo, file_id, language, 'm' || w, CASE language WHEN 'python' THEN 'function' ELSE 'method' END, s + 1,
       CASE language WHEN 'python' THEN s + 2 ELSE s + 1 END, w, 1,
       CASE WHEN language = 'python' THEN '(self)' WHEN language = 'java' AND is_class THEN '(int a)' ELSE '()' END
FROM fx_parts WHERE w IS NOT NULL AND ((is_class AND language <> 'go') OR (language = 'java'))
UNION ALL
SELECT repo, file_id, language, 'n' || w, 'method', s + 1, s + 1, w, 1, CASE language WHEN 'java' THEN '()' ELSE '(a)' END
FROM fx_parts WHERE w IS NOT NULL AND is_class AND language IN ('javascript', 'java')"""

_CONTENTS = """
SELECT 'repo_' || lang AS repo, doc_id AS file_id, '/repo_' || lang || '/' || rel_path AS path, rel_path,
       source AS language, text AS content
FROM (SELECT *, CASE doc_id % 4
        WHEN 0 THEN 'main_d' || doc_id || '.' || lang
        WHEN 1 THEN source || '/d' || doc_id || '.' || lang
        WHEN 2 THEN source || '/' || lang || '/d' || doc_id || '.' || lang
        ELSE source || '/' || lang || '/pkg' || (doc_id % 7) || '/d' || doc_id || '.' || lang END AS rel_path
      FROM documents) t"""

_LINES = """
SELECT repo, file_id, line, CASE WHEN right(text, 1) = chr(13) THEN left(text, length(text) - 1) ELSE text END AS text
FROM (SELECT repo, file_id, CAST(unnest(range(1, len(a) + 1)) AS INT) AS line, unnest(a) AS text, len(a) AS n
      FROM (SELECT repo, file_id, string_split(content, chr(10)) AS a FROM fx_contents) x) y
WHERE NOT (line = n AND text = '')"""

_FILES = """
SELECT c.repo, c.file_id, c.path, c.rel_path, c.language, sha256(c.content) AS hash, c.file_id * 1000 AS mtime_us,
       CAST(octet_length(CAST(encode(c.content) AS BLOB)) AS BIGINT) AS size, CAST(coalesce(n, 0) AS INT) AS n_lines
FROM fx_contents c LEFT JOIN (SELECT file_id, count(*) AS n FROM fx_lines GROUP BY file_id) l USING (file_id)"""

_HEADS = """
SELECT l.repo, l.file_id, l.line, l.text, f.n_lines, f.language, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS name,
       CAST((l.line - 1) % 6 AS INT) AS pos, CAST(l.line - (l.line - 1) % 6 AS INT) AS block_line
FROM (SELECT *, regexp_extract(text, '^([A-Za-z]+)', 1) AS w FROM fx_lines) l JOIN fx_files f USING (file_id)
WHERE length(w) >= 4"""

_SYMBOLS = """
SELECT h.repo, h.file_id * 100000 + h.line AS symbol_id, h.file_id, h.name,
       CASE WHEN h.pos = 0 THEN 'class' WHEN h.pos IN (1, 3) THEN 'function' ELSE 'variable' END AS kind,
       h.line AS start_line,
       CASE WHEN h.pos = 0 THEN least(h.line + 5, h.n_lines) WHEN h.pos IN (1, 3) THEN least(h.line + 1, h.n_lines)
            ELSE h.line END AS end_line,
       0 AS start_col, CAST(length(h.text) AS INT) AS end_col,
       CASE WHEN h.pos = 0 THEN '' ELSE coalesce(c.name, '') END AS parent,
       CASE WHEN h.pos = 0 OR c.name IS NULL THEN 0 ELSE 1 END AS depth,
       CASE WHEN h.pos = 0 THEN substr(h.text, 1, 120)
            WHEN h.pos IN (1, 3) THEN '(' || substr(h.text, 1, 20) || chr(10) || substr(h.text, 21, 20) || ')'
            ELSE '' END AS signature, h.language
FROM fx_heads h LEFT JOIN fx_heads c ON c.file_id = h.file_id AND c.line = h.block_line AND c.pos = 0"""

_REFS = """
SELECT x.repo, x.file_id, x.line, x.ord, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS name, f.language
FROM (SELECT repo, file_id, line, CAST(unnest(range(0, len(a))) AS INT) AS ord, unnest(a) AS w
      FROM (SELECT repo, file_id, line, regexp_extract_all(text, '[A-Za-z]+') AS a FROM fx_lines) y) x
JOIN fx_files f USING (file_id)
WHERE ord > 0 AND length(w) >= 6"""

_IMPORTS = """
SELECT f.repo, f.file_id,
       CASE WHEN f.file_id % 2 = 0 THEN replace(d.target, '/', '.') ELSE regexp_replace(d.target, '[.][a-z]+$', '') END
       AS raw_path, f.language
FROM (SELECT repo, file_id, name FROM fx_refs UNION SELECT repo, file_id, name FROM fx_symbols) r
JOIN (SELECT s.repo, s.name, min(t.rel_path) AS target FROM fx_symbols s JOIN fx_files t ON t.file_id = s.file_id
      GROUP BY s.repo, s.name) d ON d.repo = r.repo AND d.name = r.name
JOIN fx_files f ON f.file_id = r.file_id
WHERE d.target <> f.rel_path"""

_STORED = """
SELECT f.repo, f.path, f.language, f.mtime_us - CASE WHEN l.quality = 0 THEN 500 ELSE 0 END AS mtime_us,
       f.size + l.toxic AS size
FROM fx_files f JOIN labels l ON l.doc_id = f.file_id
UNION ALL
SELECT 'repo_en', '/gone/page_' || page_id, 'html', page_id * 1000, length(html) FROM pages"""

_CHANGES = """
SELECT 'events' AS repo, '/repo/u' || user_id AS path,
       CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, ts, event_id FROM events"""

_RULES = (
    "SELECT r.repo, v.* FROM (SELECT DISTINCT repo FROM fx_files) r, (VALUES "
    + ", ".join(f"({o}, '{b}', '{p}', {n}, {d}, {a})" for o, b, p, n, d, a in IGNORE_RULES)
    + ") AS v(ord, base_dir, pattern, negated, dir_only, anchored)"
)

_HUNKS = """
SELECT s.repo, s.file_id, s.start_line, s.name,
       '@@ -' || s.start_line || ',3 +' || s.start_line
       || CASE s.start_line % 5 WHEN 0 THEN '' WHEN 1 THEN ',0' ELSE ',2' END || ' @@' AS header,
       CASE s.start_line % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS cnt
FROM fx_symbols s WHERE s.kind = 'class'"""

_TARGETS = """
SELECT DISTINCT repo, unnest([name, file || ':' || name, CASE WHEN parent <> '' THEN parent || '.' || name ELSE name END,
       upper(name), lower(substr(name, 1, 5))]) AS target
FROM (SELECT s.repo, s.name, max(f.rel_path) AS file, max(s.parent) AS parent
      FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id GROUP BY s.repo, s.name) n
UNION ALL
SELECT DISTINCT repo, 'Nosuchname' FROM fx_files"""

_BODIES = """
SELECT s.repo, f.rel_path, s.file_id, s.symbol_id, s.kind, s.parent, s.name, s.start_line,
       sha256(string_agg(l.text, chr(10) ORDER BY l.line)) AS body_hash
FROM fx_symbols s JOIN fx_files f ON f.file_id = s.file_id
JOIN fx_lines l ON l.file_id = s.file_id AND l.line BETWEEN s.start_line AND s.end_line
GROUP BY ALL"""

_OLD = """
SELECT b.repo, b.rel_path, b.kind, b.parent, CASE WHEN l.toxic = 1 THEN b.name || 'Old' ELSE b.name END AS name,
       b.start_line, CASE WHEN l.quality = 0 THEN 'x' || b.body_hash ELSE b.body_hash END AS body_hash
FROM fx_bodies b JOIN labels l ON l.doc_id = b.file_id"""

# In dependency order; the oracle prefixes a query with the views it names.
FIXTURE_SQL = {
    "fx_contents": _CONTENTS,
    "fx_lines": _LINES,
    "fx_files": _FILES,
    "fx_heads": _HEADS,
    "fx_symbols": _SYMBOLS,
    "fx_refs": _REFS,
    "fx_imports": _IMPORTS,
    "fx_stored": _STORED,
    "fx_changes": _CHANGES,
    "fx_rules": _RULES,
    "fx_hunks": _HUNKS,
    "fx_targets": _TARGETS,
    "fx_bodies": _BODIES,
    "fx_old": _OLD,
    "fx_parts": _PARTS,
    "fx_src_symbols": _SRC_SYMBOLS,
}
