"""Path expressions: language, parts, dotted form, skip lists. All stay inside codegen."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.constants import (
    EXTENSION_LANGUAGE,
    FILENAME_LANGUAGE,
    SKIP_DIRECTORIES,
    SUPPORTED_LANGUAGES,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def dir_name(path: Column | str) -> Column:
    """Everything before the last slash, ``.`` when there is none."""
    p = _col(path)
    return F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise(".")


def extension(path: Column | str) -> Column:
    """From the last dot of the base name on, the dot included; ``''`` when there is none."""
    return F.regexp_extract(_col(path), r"(\.[^./]*)$", 1)


def stem(path: Column | str) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def depth_of(path: Column | str) -> Column:
    """Number of slashes."""
    p = _col(path)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))


def dotted(path: Column | str) -> Column:
    return F.replace(_col(path), F.lit("/"), F.lit("."))


def dotted_variants(path: Column | str) -> Column:
    """Module spellings of a file: dotted, without ``.go`` anywhere, without ``.py`` anywhere."""
    d = dotted(path)
    return F.array_distinct(F.array(
        d, F.replace(d, F.lit(".go"), F.lit("")), F.replace(d, F.lit(".py"), F.lit(""))
    ))


def detect_language(path: Column | str) -> Column:
    """Language by extension, then by special file name, else ``''``."""
    return F.coalesce(
        _lookup(EXTENSION_LANGUAGE, extension(path)),
        _lookup(FILENAME_LANGUAGE, base_name(path)),
        F.lit(""),
    )


def is_supported(language: Column | str) -> Column:
    return _col(language).isin(*SUPPORTED_LANGUAGES)


def in_skipped_directory(rel_path: Column | str) -> Column:
    """True when any directory on the way is on the skip list or hidden; dot *files* stay."""
    parts = F.split(_col(rel_path), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRECTORIES) | (F.startswith(d, F.lit(".")) & (d != ".")))


def package_of(rel_path: Column | str) -> Column:
    """First two path segments (a file directly below a folder counts as its own package)."""
    p = _col(rel_path)
    return F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 2)).otherwise(".")


def looks_like_path(text: Column | str) -> Column:
    """Holds a slash, or is a file name with a known extension or a special name."""
    t = _col(text)
    known = F.concat(F.lit("."), F.substring_index(t, ".", -1)).isin(*EXTENSION_LANGUAGE) & (F.instr(t, ".") > 0)
    return F.contains(t, F.lit("/")) | known | t.isin(*FILENAME_LANGUAGE)
