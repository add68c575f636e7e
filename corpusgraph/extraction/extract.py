"""Symbols, imports and calls from source text: masking, rules, block ends, nesting.

The whole job is column expressions, joins and windows over files and lines. Blocks are paired in chunks of lines, other
windows "per file" hold no more than one value of the input (one content cell) did.
Accuracy is lexical; see the README for what that means compared with a syntax tree.
"""

from __future__ import annotations


from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.constants import CALLABLE_KINDS
from corpusgraph.extraction import rules as R
from corpusgraph.functions.text import normalize_call_name
from corpusgraph.operators.edges import binned_points, binned_ranges, nesting
from corpusgraph.runtime import materialise

FILE = ["repo", "file_id", "language"]


def _value_of_language(table: dict[str, str]) -> Column:
    """A constant per language, ``NULL`` for languages without one (one map lookup)."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("language"))


def _present(lines: DataFrame, languages: set[str]) -> list[str]:
    """Known languages that occur; at most one row for each reaches the driver."""
    present = {r[0] for r in lines.select("language").distinct().collect()}
    return sorted(languages & present) or [sorted(languages)[0]]


def _per_language(lines: DataFrame, languages: list[str], build: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Union of one small plan per language; each keeps its rules as constants, so patterns compile once and every
    branch stays small enough for code generation. Lines written by language are read once in all."""
    return reduce(DataFrame.unionByName, [build(lines.where(F.col("language") == lang), lang) for lang in languages])


def masked_content() -> Column:
    """``content`` with comments and string bodies blanked; every character keeps its line."""
    regex = F.coalesce(_value_of_language(R.MASKED), F.lit("(?!)"))
    pieces = F.regexp_extract_all("content", F.concat(F.lit("(?:"), regex, F.lit(")|[^\"'`/#=\\-]+|[\\s\\S]")), F.lit(0))
    special = F.concat(F.lit("^(?:"), regex, F.lit(")$"))

    def blank(piece: Column) -> Column:
        hollow = F.regexp_replace(piece, r"[^\n]", " ")
        quote = F.substring(piece, 1, 1)
        is_string = quote.isin('"', "'", "`") & (F.length(piece) >= 2)
        return F.when(is_string, F.concat(quote, F.substring(hollow, F.lit(3), F.length(hollow)), quote)).otherwise(hollow)

    def masked(piece: Column) -> Column:
        candidate = (F.length(piece) > 1) & F.substring(piece, 1, 1).isin('"', "'", "`", "/", "#", "-", "=")
        return F.when(candidate & F.regexp_like(piece, special), blank(piece)).otherwise(piece)

    return F.array_join(F.transform(pieces, masked), "")


def source_lines(contents: DataFrame) -> DataFrame:
    """(repo, file_id, language, line, text, masked); ``contents``: repo, file_id, language,
    content."""
    both = contents.select(*FILE, "content", masked_content().alias("m")).select(
        *FILE, F.arrays_zip(F.split("content", "\r?\n", -1).alias("text"), F.split("m", "\r?\n", -1).alias("masked")).alias("z")
    )
    return both.select(*FILE, F.posexplode("z").alias("pos", "z")).select(
        *FILE, (F.col("pos") + 1).alias("line"), F.col("z.text").alias("text"), F.coalesce("z.masked", F.lit("")).alias("masked")
    )


def with_parens(lines: DataFrame) -> DataFrame:
    """Adds the number of parentheses open before and after each line, that of braces before it, and Go's group
    keyword."""
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    delta, braces = _opened("()", "[]"), _opened("{}")
    opener = F.regexp_extract("masked", r"^(import|const|var|type)\s*\(\s*$", 1)
    group = F.when(opener != "", opener).when(F.regexp_like("masked", F.lit(r"^\)")), "")
    return lines.withColumn("open_after", F.sum(delta).over(w)).withColumns({
        "open_before": F.col("open_after") - delta,
        "braces_before": F.sum(braces).over(w) - braces,
        "in_group": F.when(group.isNull(), F.coalesce(F.last(group, True).over(w), F.lit(""))).otherwise(""),
    })


def _count(ch: str) -> Column:
    return F.length("masked") - F.length(F.replace("masked", F.lit(ch), F.lit("")))


def _opened(*pairs: str) -> Column:
    """Opening less closing brackets of the text in ``masked``."""
    return reduce(lambda a, b: a + b, [_count(o) - _count(c) for o, c in pairs])


def masked_lines(contents: DataFrame) -> DataFrame:
    """The line table all extractors read, written once and laid out by language."""
    return materialise(with_parens(source_lines(contents)), "masked_lines", ("language",))


def _first_match(lang_rules: list[R.SymbolRule]) -> Column:
    hits = []
    for r in lang_rules:
        name = F.regexp_extract("text" if r.raw else "masked", r.regex, 1)
        hits.append(F.when(name != "", F.struct(F.lit(r.kind).alias("kind"), name.alias("name"))))
    return F.coalesce(*hits)


def later_statements(lines: DataFrame) -> DataFrame:
    """Statements behind the first one of a line, in languages with braces: one row for each with the place ``at`` among
    the line's brackets (see ``block_events``) and its text from there on, as far as ``R.STATEMENT_PARTS`` parts.

    A statement begins behind ``{``, ``}`` or ``;`` outside of parentheses. Places and depths are running sums over the
    parts of one line, so a file in one line costs one sorted pass.
    """
    several = lines.where(F.col("language").isin(*R.MANY_STATEMENTS) & F.regexp_like("masked", F.lit(R.NEXT_STATEMENT)))
    parts = several.select(*FILE, "line", "open_before", F.posexplode(F.split("masked", R.STATEMENT_CUT, -1)).alias("part", "masked"))
    w = Window.partitionBy("language", "file_id", "line").orderBy("part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (
        parts.withColumns({
            "depth": F.col("open_before") + F.sum(_opened("()", "[]")).over(before),
            "at": (2 * F.sum(_count("{") + _count("}") + _count(";")).over(before)).cast("int"),
            "col": F.sum(F.length("masked")).over(before),
            "ahead": F.array_join(F.collect_list("masked").over(w.rowsBetween(0, R.STATEMENT_PARTS - 1)), ""),
        })
        .where("part > 0 AND depth <= 0")
        .select(
            *FILE, "line", "at", (F.col("col") + F.length("masked") - F.length(F.ltrim("masked"))).cast("int").alias("col"),
            F.concat(F.when(F.col("language") == "go", "").otherwise(" "), F.ltrim("ahead")).alias("masked"),
        )
        .withColumns({"text": F.col("masked"), "in_group": F.lit(""), "open_before": F.lit(0).cast("bigint"),
                      "open_after": F.lit(0).cast("bigint"), "braces_before": F.lit(1).cast("bigint")})
    )


def definition_lines(lines: DataFrame, rules: list[R.SymbolRule] | None = None) -> DataFrame:
    """One row per definition: kind, name, its line, the place ``at`` among the line's brackets, its column and text.
    The first rule that fits a statement wins."""
    rules = R.SYMBOL_RULES if rules is None else rules

    def of_language(part: DataFrame, lang: str) -> DataFrame:
        hit = _first_match([r for r in rules if r.language == lang])
        if lang == "go":
            member = F.regexp_extract("masked", R.GO_GROUP_NAME, 1)
            kind = F.when(F.col("in_group") == "const", "constant").otherwise("variable")
            grouped = F.col("in_group").isin("const", "var") & (F.col("open_before") == 1) & (member != "")
            in_types = (F.col("in_group") == "type") & (F.col("open_before") == 1) & (F.col("braces_before") == 0)
            hit = F.coalesce(
                F.when(grouped, F.struct(kind.alias("kind"), member.alias("name"))),
                F.when(in_types, _first_match(R.GO_TYPE_GROUP)), hit)
        found = part.withColumn("d", hit).where("d IS NOT NULL")
        name = F.col("d.name")
        if lang == "hcl":  # labels of a block are joined by dots
            name = F.replace(F.regexp_replace(name, r'"\s+"', "."), F.lit('"'), F.lit(""))
        return found.withColumns({"kind": F.col("d.kind"), "name": name}).drop("d")

    first = lines.withColumns({"at": F.lit(0), "col": F.length(F.regexp_extract("text", r"^(\s*)", 1))})
    present = _present(lines, {r.language for r in rules})
    found = _per_language(first, present, of_language)
    several = [lang for lang in present if lang in R.MANY_STATEMENTS]
    if not several:
        return found
    more = _per_language(later_statements(lines), several, of_language)
    return found.select(more.columns).unionByName(more)


def block_events(lines: DataFrame) -> DataFrame:
    """Openers (1), closers (-1) and statement ends (0) in reading order: (file_id, line, at, step). The k-th of a line
    lies at ``2 k + 1``, so a statement that begins behind k of them has its place at ``2 k``."""
    none = F.array().cast("array<string>")
    opens_and_closes = {**dict.fromkeys(R.BRACES, "[{};]"), **{lang: rx for lang, (rx, _) in R.BLOCK_EVENTS.items()}}
    regex = F.coalesce(_value_of_language(opens_and_closes), F.lit("(?!)"))
    ended = F.col("language").isin(*R.LINE_ENDED) & (
        (F.col("open_after") <= 0) | ((F.col("in_group") != "") & (F.col("open_after") == 1))
    )
    tokens = F.concat(F.regexp_extract_all("masked", regex, F.lit(0)), F.when(ended, F.array(F.lit(";"))).otherwise(none))
    closer = F.coalesce(_value_of_language({lang: rx for lang, (_, rx) in R.BLOCK_EVENTS.items()}), F.lit("^\\}$"))
    closes = F.regexp_like("tok", closer)
    step = F.when(F.col("tok").like("%do:") | (F.col("tok") == ";"), 0).when(closes, -1).otherwise(1)
    return (
        lines.select("file_id", "language", "line", F.posexplode(tokens).alias("ord", "tok"))
        .select("file_id", "line", (2 * F.col("ord") + 1).alias("at"), step.alias("step"))
    )


def block_ends(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """``end_line`` and ``end_at`` per definition (file_id, line, at).

    Brackets pair by depth: within one (file, depth) the event after an opener is its closer.
    Then the next event behind a definition decides: an opener ends at its closer, anything else
    ends the definition where it stands.

    Events and definitions are dealt once, by (file, chunk of lines), and read in order within their chunk, so no task
    holds more than a chunk however long a file is. Depths begin with the sums of the chunks before. What a chunk cannot
    settle by itself goes on as a small table: definitions, brackets without their partner, and first events of chunks.
    """
    settled = materialise(_within_chunks(block_events(lines), definitions), "block_rows")
    file_order = Window.partitionBy("file_id", "level").orderBy("of")
    alone = settled.where("alone").withColumn("close", F.lead("of").over(file_order)).where("step = 1")
    alone = alone.select("file_id", "of", "close")

    starts = settled.where("is_start").select("file_id", "chunk", "line", "at", "next")
    first = settled.where("is_first").select(
        "file_id", "chunk", F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("at"),
        F.struct("step", "of", "until").alias("next"))
    later = Window.partitionBy("file_id").orderBy(F.desc("chunk"), F.col("line").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    of_chunk = F.when(F.col("line").isNull(), F.col("next"))
    found = starts.where("next IS NULL").unionByName(first).withColumn("next", F.coalesce("next", F.last(of_chunk, True).over(later)))
    found = found.where("line IS NOT NULL").unionByName(starts.where("next IS NOT NULL")).withColumn("of", F.col("next.of"))
    found = found.join(alone, ["file_id", "of"], "left")
    opener = F.when(F.col("next.step") == 1, F.coalesce("next.until", "close", "next.of"))
    until = F.coalesce(opener, "next.until", F.struct("line", "at"))
    return found.select("file_id", "line", "at", until["line"].alias("end_line"), until["at"].alias("end_at"))


def _within_chunks(events: DataFrame, definitions: DataFrame) -> DataFrame:
    """What is known of each definition within its chunk (``next``: the event behind it), and the brackets that stand
    ``alone`` in theirs and first events of chunks, with their ``level``, place ``of`` and the place ``until``."""
    chunk = F.shiftright(F.col("line"), R.CHUNK_SHIFT).alias("chunk")
    key, place = ["file_id", "chunk"], F.struct("line", "at")
    rows = events.select("file_id", chunk, "line", "at", "step", F.lit(False).alias("is_start")).unionByName(
        definitions.select("file_id", chunk, "line", "at", F.lit(0).alias("step"), F.lit(True).alias("is_start")))
    earlier = Window.partitionBy("file_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*key).agg(F.sum("step").alias("total"))
    base = base.select(*key, F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    forwards = Window.partitionBy(*key).orderBy("line", "at").rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col("base") + F.sum("step").over(forwards) + F.when(F.col("step") == -1, 1).otherwise(0)
    event = ~F.col("is_start")
    rows = rows.join(base, key).withColumns({
        "level": F.when(F.col("step") != 0, depth), "is_first": event & (F.sum(event.cast("int")).over(forwards) == 1), "of": place,
    })
    same_level = Window.partitionBy(*key, "level").orderBy("line", "at")
    rows = rows.withColumns({"partner": F.lead("of").over(same_level), "before": F.lag("of").over(same_level)})
    rows = rows.withColumns({
        "until": F.when(F.col("step") == 1, F.col("partner")).when(event & (F.col("step") == 0), F.col("of")),
        "alone": ((F.col("step") == 1) & F.col("partner").isNull()) | ((F.col("step") == -1) & F.col("before").isNull()),
    })
    backwards = Window.partitionBy(*key).orderBy(F.desc("line"), F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.last(F.when(event, F.struct("step", "of", "until")), True).over(backwards))
    return rows.where("is_start OR alone OR is_first").select(
        *key, "line", "at", "step", "level", "of", "until", "next", "is_start", "is_first", "alone")


def indented_ends(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """As ``block_ends`` for Python: the last code line before one indented no deeper.

    A line closes every definition level at or right of its indent; lines inside an open bracket
    close nothing. Levels are the distinct indents of the file's definitions, so a line is copied
    at most once per level.
    """
    indent = F.length(F.regexp_extract("masked", r"^(\s*)", 1))
    w = Window.partitionBy("file_id").orderBy("line")
    code = (
        lines.where("language = 'python' AND trim(masked) <> ''").withColumn("indent", indent)
        .withColumn("before", F.lag("line").over(w))
    )
    last = code.groupBy("file_id").agg(F.max("line").alias("last_line"))
    levels = (
        definitions.where("language = 'python'").withColumn("indent", indent)
        .groupBy("file_id").agg(F.collect_set("indent").alias("levels"))
    )
    by_level = Window.partitionBy("file_id", "level").orderBy("line")
    closers = (
        code.where("open_before <= 0").join(levels, "file_id")
        .select("file_id", "line", "indent", "before", F.explode(F.filter("levels", lambda x: x >= F.col("indent"))).alias("level"))
        .withColumn("end_line", F.lead("before").over(by_level)).where("level = indent")
    )
    closers = closers.join(definitions.where("language = 'python'").select("file_id", "line"), ["file_id", "line"], "left_semi")
    return closers.join(last, "file_id").select(
        "file_id", "line", F.lit(0).alias("at"), F.coalesce("end_line", "last_line").alias("end_line"), F.lit(R.LINE_END).alias("end_at"))


def _decorated_start(lines: DataFrame) -> DataFrame:
    """First decorator line of the run directly above each Python line (file_id, line, start)."""
    w = Window.partitionBy("file_id").orderBy("line")
    marked = lines.where("language = 'python'").withColumn("dec", F.regexp_like("masked", F.lit(r"^\s*@")))
    run = F.last(F.when(~F.col("dec"), F.col("line")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return marked.select("file_id", "line", (F.coalesce(run, F.lit(0)) + 1).alias("start"))


def extract_symbols(contents: DataFrame, rules: list[R.SymbolRule] | None = None) -> DataFrame:
    """Symbol facts of source files (repo, file_id, language, content), nested and with signatures."""
    return symbols_of(masked_lines(contents), rules)


def written_definitions(lines: DataFrame, rules: list[R.SymbolRule] | None = None) -> DataFrame:
    """The definition lines, written once: block ends, nesting and calls all read them."""
    return materialise(definition_lines(lines, rules), "definitions")


def symbols_of(
    lines: DataFrame, rules: list[R.SymbolRule] | None = None, definitions: DataFrame | None = None
) -> DataFrame:
    found = written_definitions(lines, rules) if definitions is None else definitions
    ends = ends_of(lines, found)
    callable_kind = F.col("kind").isin(*R.CALLABLES)
    signature = F.when(callable_kind, F.coalesce("params", _parameter_list())).when(
        F.col("kind").isin(*R.TYPE_LIKE), F.substring(F.regexp_extract("text", r"^\s*([^{\r\n]*)", 1), 1, 120),
    ).otherwise("")
    with_end = (
        found.join(ends, ["file_id", "line", "at"])
        .join(_long_parameters(lines, found.where(callable_kind)), ["file_id", "line", "at"], "left")
        .join(_decorated_start(lines), ["file_id", "line"], "left")
        .withColumn("start_line", F.coalesce("start", "line"))
        .withColumn("start_col", F.col("col"))
        .withColumn("signature", signature)
        .withColumn("end_line", F.greatest("end_line", "line"))
        .withColumn("symbol_id", F.xxhash64("file_id", "line", "at", "name"))
        .withColumns({"end_col": F.lit(0), "start_pos": _position("start_line", "at"), "end_pos": _position("end_line", "end_at")})
    )
    plain = with_end.select(
        "repo", "symbol_id", "file_id", "name", "kind", "start_line", "end_line", "start_col", "end_col", "signature", "language",
        "start_pos", "end_pos",
    )
    plain = materialise(plain, "flat_symbols")
    nested = _without_locals(nesting(plain, with_id=True, exact=True).drop("start_pos", "end_pos"))
    holder = plain.select("file_id", F.col("name").alias("parent"), F.col("kind").alias("parent_kind"),
                          F.col("start_line").alias("p_start"), F.col("end_line").alias("p_end"))
    return _member_kinds(nested, holder)


def _position(line: str, at: str) -> Column:
    """A place as one number that orders by line, then among the line's brackets."""
    return F.shiftleft(F.col(line).cast("bigint"), R.AT_BITS) + F.least(F.col(at), F.lit(R.LINE_END))


def ends_of(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """``end_line`` and ``end_at`` of every definition: by brackets, in Python by indentation."""
    by_brackets = block_ends(lines.where("language <> 'python'"), definitions.where("language <> 'python'"))
    return by_brackets.unionByName(indented_ends(lines, definitions))


def _parameter_list() -> Column:
    """The bracketed list behind ``name``: matched on the masked text, cut from the source text at the same place."""
    before = F.lit(r"^([\s\S]*?\Q")
    rule = F.concat(before, "name", F.lit("\\E" + R.BEFORE_PARAMETERS + ")(" + R.PARAMETERS + ")"))
    pieces = F.call_function("regexp_replace", F.col("masked"), F.concat(rule, F.lit(r"[\s\S]*$")), F.lit("$1\u0001$2\u0001"))
    start = F.instr(pieces, "\u0001")
    length = F.length(pieces) - start - 1
    return F.when(start > 0, F.substring("text", start, length)).otherwise("")


def _long_parameters(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """``params`` of definitions (file_id, line, at) whose list is open at the end of their line.

    The next line of the file that falls back to the depth before it closes the list: closing lines are listed once for
    each depth they close, and paired within (file, depth).
    """
    key = ["file_id", "line", "at"]
    longer = definitions.where(F.col("open_after") > F.col("open_before")).select(*key, "name", "open_before")
    closing = lines.where("open_after < open_before").select(
        "file_id", F.explode(F.sequence("open_after", F.col("open_before") - 1)).alias("level"), F.lit(None).cast("int").alias("at"), "line")
    rows = closing.unionByName(longer.select("file_id", F.col("open_before").alias("level"), "at", "line"))
    behind = Window.partitionBy("file_id", "level").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    closed = rows.withColumn("last", F.last(F.when(F.col("at").isNull(), F.col("line")), True).over(behind)).where("at IS NOT NULL")
    wanted = closed.select(*key, F.explode(F.sequence("line", F.coalesce("last", "line"))).alias("of"))
    pieces = wanted.join(lines.select("file_id", F.col("line").alias("of"), "text", "masked"), ["file_id", "of"])
    joined = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("of", "text", "masked"))).alias("p"))  # one list's lines
    joined = joined.select(*key, F.array_join("p.text", "\n").alias("text"), F.array_join("p.masked", "\n").alias("masked"))
    return longer.select(*key, "name").join(joined, key).select(*key, _parameter_list().alias("params"))


def _without_locals(symbols: DataFrame) -> DataFrame:
    """Declarations that look like fields but lie directly in a function are its local variables."""
    holders = symbols.where(F.col("kind").isin(*R.LOCAL_HOLDERS)).select(F.col("symbol_id").alias("parent_id"))
    fields = symbols.where(F.col("language").isin(*R.LOCALS_LIKE_FIELDS) & (F.col("kind") == "field"))
    found = fields.join(holders, "parent_id", "left_semi").select("symbol_id")
    return symbols.join(found, "symbol_id", "left_anti").drop("parent_id")


def _member_kinds(symbols: DataFrame, holders: DataFrame) -> DataFrame:
    """Kotlin and Dart functions and Kotlin properties directly inside a type are its members."""
    types = holders.where(F.col("parent_kind").isin("class", "interface", "object", "enum", "mixin", "extension"))
    inside = (
        symbols.where(F.col("language").isin("kotlin", "dart") & (F.col("parent") != "")).join(types, ["file_id", "parent"])
        .where("start_line BETWEEN p_start AND p_end").select("symbol_id").distinct().withColumn("member", F.lit(True))
    )
    kind = (
        F.when(F.col("member") & F.col("kind").isin(CALLABLE_KINDS[0]), "method")
        .when(F.col("member") & (F.col("language") == "kotlin") & (F.col("kind") == "variable"), "field")
        .otherwise(F.col("kind"))
    )
    return symbols.join(inside, "symbol_id", "left").withColumn("kind", kind).drop("member")


def imports_of(lines: DataFrame, rules: list[R.ImportRule] | None = None) -> DataFrame:
    """Raw import strings. A Python statement over several lines is one import, its text whole."""
    rules = R.IMPORT_RULES if rules is None else rules

    def match(rule: R.ImportRule) -> Column:
        found = F.regexp_extract("text", rule.regex, 1)
        return F.when((F.col("in_group") == rule.block) & (found != ""), found)

    def of_language(part: DataFrame, lang: str) -> DataFrame:
        raw = F.coalesce(*[match(r) for r in rules if r.language == lang])
        live = part.where(F.regexp_like("masked", F.lit(r"\S")))
        return live.select("repo", "file_id", raw.alias("raw_path"), "language").where("raw_path IS NOT NULL")

    plain = _per_language(lines, _present(lines, {r.language for r in rules}), of_language)
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(F.col("open_before") <= 0, F.col("line")), True).over(w)
    statements = (
        lines.where("language = 'python'").withColumn("first", first)
        .groupBy(*FILE, "first").agg(F.sort_array(F.collect_list(F.struct("line", "text", "masked"))).alias("s"))
        .where(F.regexp_like(F.col("s")[0]["masked"], F.lit(R.PYTHON_IMPORT)))
        .select("repo", "file_id", F.trim(F.array_join("s.text", "\n")).alias("raw_path"), "language")
    )
    return plain.unionByName(statements)


def refs_of(lines: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """Call sites, one per call: (repo, file_id, line, ord, name, language); definitions drop out."""
    defs = (written_definitions(lines) if definitions is None else definitions).select(*FILE, "line", "at", "kind", "name")
    calls = F.regexp_extract_all("masked", F.lit(R.CALL), F.lit(0))
    lang, lead = F.col("language"), F.regexp_extract("call", R.CALL_LEAD, 1)
    raw_name = F.regexp_replace(F.regexp_replace("call", R.CALL_LEAD, ""), r"\s*\($", "")
    found = (
        lines.where(lang.isin(*R.CALLS))
        .select(*FILE, "line", F.posexplode(calls).alias("ord", "call"))
        .where(~F.regexp_like("call", F.lit(R.GO_GROUP_OPEN)) | (lang != "go"))
        .where(~F.startswith("call", F.lit("@")) | lang.isin(*R.DECORATED_CALLS))
        .withColumns({"lead": lead, "raw_name": raw_name})
        .where(~F.col("lead").isin(*R.DEFINING_LEAD) & (~lang.isin(*R.TYPED) | F.col("lead").isin(*R.CALL_LEAD_WORDS)))
        .where(~F.endswith("raw_name", F.lit("!")) | lang.isin(*R.BANG_NAMES))
        .withColumn("name", normalize_call_name("raw_name", "language"))
        .where((F.col("name") != "") & ~F.col("name").isin(*R.NOT_CALLED))
        .select("repo", "file_id", "line", "ord", "name", "language")
    )
    found = _outside_interfaces(found, lines, defs)
    spot = ["file_id", "line", "name"]
    defs = defs.select("file_id", "line", normalize_call_name("name", "language").alias("name")).groupBy(*spot).agg(F.count("*").alias("times"))
    # The first mentions of a name on the line that defines it are the definitions themselves.
    heads = found.join(defs, spot).withColumn("nth", F.row_number().over(Window.partitionBy(*spot).orderBy("ord")))
    return found.join(heads.where("nth <= times").select(*spot, "ord"), [*spot, "ord"], "left_anti")


def _outside_interfaces(refs: DataFrame, lines: DataFrame, defs: DataFrame) -> DataFrame:
    """Drops "calls" that are members listed by an interface."""
    listing = F.col("language").isin(*R.INTERFACE_MEMBERS)
    interfaces = defs.where(listing & (F.col("kind") == "interface"))
    ranges = binned_ranges(block_ends(lines.where(listing), interfaces).withColumnRenamed("line", "start_line"))
    listed = (
        binned_points(refs.where(listing).select("file_id", "line").distinct()).join(ranges, ["file_id", "bin"])
        .where("line BETWEEN start_line AND end_line").select("file_id", "line").distinct()
    )
    return refs.join(listed, ["file_id", "line"], "left_anti")


def extract_imports(contents: DataFrame) -> DataFrame:
    return imports_of(masked_lines(contents))


def extract_refs(contents: DataFrame) -> DataFrame:
    return refs_of(masked_lines(contents))


