"""Text expressions: tokens, call names, signatures, hunk headers, target strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.paths import looks_like_path


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; no camel-case split."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalize_call_name(text: Column | str, language: Column | str) -> Column:
    """Final name of a call expression, ``''`` when what is left is no plain name.

    C and C++ cut after the last of ``.``, ``->``, ``::``; C++ also drops a trailing ``<...>``;
    every other language cuts after the last ``.`` only, so ``a::b`` stays whole there.
    """
    lang = _col(language)
    trimmed = F.regexp_replace(_col(text), r"^\s+|\s+$", "")
    c_name = F.regexp_replace(trimmed, r"^[\s\S]*(?:\.|->|::)", "")
    cpp_name = F.when(F.endswith(c_name, F.lit(">")), F.regexp_replace(c_name, r"^([^<]+)<[\s\S]*$", "$1")).otherwise(c_name)
    other = F.regexp_replace(trimmed, r"^[\s\S]*\.", "")
    name = F.when(lang == "cpp", cpp_name).when(lang == "c", c_name).otherwise(other)
    return F.when(F.regexp_like(name, F.lit(r"[()\[\]{}]")), F.lit("")).otherwise(name)


def signature_head(signature: Column | str) -> Column:
    """First line of a signature, marked with `` ...`` when more follows."""
    s = _col(signature)
    return F.when(F.instr(s, "\n") > 0, F.concat(F.substring_index(s, "\n", 1), F.lit(" ..."))).otherwise(s)


def symbol_identity() -> Column:
    """``rel_path:language:kind:name:start_line``."""
    return F.concat_ws(":", "rel_path", "language", "kind", "name", F.col("start_line").cast("string"))


def hunk_range(header: Column | str) -> tuple[Column, Column]:
    """(start, end) of the new side of ``@@ -a[,b] +c[,d] @@``; NULLs when it is no hunk header.

    A missing count is one line, a count of zero a single position.
    """
    h = _col(header)
    start = F.regexp_extract(h, r"\+(\d+)(?:,(\d+))? ", 1)
    count = F.regexp_extract(h, r"\+(\d+)(?:,(\d+))? ", 2)
    lo = F.when(start != "", start.cast("int"))
    n = F.when(count == "", F.lit(1)).otherwise(count.cast("int"))
    return lo, F.when(n == 0, lo).otherwise(lo + n - 1)


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def starts_with_capital(name: Column | str) -> Column:
    return F.regexp_like(_col(name), F.lit("^[A-Z]"))


def with_parsed_target(df: DataFrame) -> DataFrame:
    """Adds file, symbol, start_line, end_line, is_path read from the ``target`` column.

    ``path:L10-L20`` and ``path:10`` name lines, ``file:Symbol`` a symbol in a file (the left
    side must hold a slash or a known file name), anything else is a symbol. Dots in the symbol
    are left alone; see :func:`dotted_parts`. Built in steps so that no piece is computed twice.
    """
    t = F.col("target")
    kept = df.columns
    right = F.when(F.instr(t, ":") > 1, F.substring_index(t, ":", -1))
    cut = df.withColumn("_right", right).withColumn(
        "_left", F.expr("left(target, length(target) - length(_right) - 1)")
    )
    flags = cut.withColumns({
        "_path_left": F.coalesce(looks_like_path("_left"), F.lit(False)),
        "_first": F.regexp_extract("_right", r"^L?(\d+)(?:-[\s\S]*)?$", 1),
        "_second": F.regexp_extract("_right", r"^L?\d+-L?(\d+)$", 1),
    })
    lines = F.col("_path_left") & (F.col("_first") != "")
    forms = flags.withColumn(
        "_form",
        F.when(lines, "lines").when(F.col("_path_left") & (F.col("_right") != ""), "symbol")
        .when(~F.col("_path_left") & looks_like_path("target"), "path").otherwise("name"),
    )
    form = F.col("_form")
    start = F.when(form == "lines", F.col("_first").cast("int")).otherwise(0)
    return forms.select(
        *kept,
        F.when(form.isin("lines", "symbol"), F.col("_left")).when(form == "path", t).otherwise("").alias("file"),
        F.when(form == "symbol", F.col("_right")).when(form == "name", t).otherwise("").alias("symbol"),
        start.alias("start_line"),
        F.when((form == "lines") & (F.col("_second") != ""), F.col("_second").cast("int")).otherwise(start).alias("end_line"),
        form.isin("lines", "path").alias("is_path"),
    )


def dotted_parts(symbol: Column | str) -> tuple[Column, Column]:
    """(parent, name) of ``Parent.name``, split at the first dot; parent ``''`` without a dot."""
    s = _col(symbol)
    has_dot = F.instr(s, ".") > 0
    return (
        F.when(has_dot, F.substring_index(s, ".", 1)).otherwise(""),
        F.when(has_dot, F.regexp_replace(s, r"^[^.]*\.", "")).otherwise(s),
    )
