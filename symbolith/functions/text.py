"""Expressions over paths, scopes and signatures; all built-in functions, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a signature that are stored, and that are shown (fixed values).
STORED, SHOWN = 1024, 256


def scope_depth(scope: Column) -> Column:
    """Levels of a scope: one more than its separators (., \\ and ::)."""
    return F.size(F.regexp_extract_all(scope, F.lit(r"(::|[.\\])"), F.lit(0))) + 1


def cut_bytes(text: Column, limit: int) -> Column:
    """The text if it has at most ``limit`` bytes in UTF-8, else its longest beginning that has."""
    data = F.encode(text, "UTF-8")
    starts = lambda k: F.hex(F.substring(data, limit + 1 - k, 1)).rlike("^(?![89AB])")  # noqa: E731  not in a character
    end = F.when(starts(0), limit).when(starts(1), limit - 1).when(starts(2), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(data.substr(F.lit(1), end.cast("int")), "UTF-8"))


def shown(signature: Column) -> Column:
    """A signature as it is displayed."""
    cut = cut_bytes(signature, SHOWN)
    return F.when(F.octet_length(signature) > SHOWN, F.concat(cut, F.lit(" [truncated]"))).otherwise(signature)


def normalised(signature: Column) -> Column:
    """White space collapsed, none before or behind an opening parenthesis or before a closing one."""
    flat = F.regexp_replace(F.regexp_replace(signature, r"\s+", " "), "^ | $", "")
    return F.regexp_replace(F.regexp_replace(flat, r" ?\( ?", "("), r" \)", ")")


def path_order(path: Column) -> Column:
    """Sort key: paths in order of their components."""
    return F.split(path, "/")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or if the name begins with its only dot."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1), F.lit(""))


def relative(path: Column, base: str) -> Column:
    """The path below ``base``, or the path itself if it isn't below it."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def hidden(path: Column) -> Column:
    """Whether a component of the path begins with a dot."""
    return path.rlike(r"(^|/)\.[^/]")
