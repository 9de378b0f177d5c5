"""Globs and ignore rules, compiled on the driver to predicates over relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    """A glob as a regular expression for a whole relative path.

    ``*`` and ``?`` stay inside a component, ``**`` spans components, ``[...]`` and ``{a,b}`` are sets.  Without a
    slash (but for one at the end) a glob matches at any depth.  ValueError if it is malformed.
    """
    body = glob.removeprefix("/")
    anchored = glob.startswith("/") or "/" in body.rstrip("/")
    body = body.rstrip("/")
    out, i, depth = "", 0, 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if body.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = body.find("]", i + 2)
            if end < 0:
                raise ValueError(f"invalid glob: {glob}")
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += f"[{'^' + inner[1:] if inner[0] in '!^' else inner}]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(body):
            i += 1
            out += "\\" + body[i]
        else:
            out += c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c
        i += 1
    if depth:
        raise ValueError(f"invalid glob: {glob}")
    return f"^{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"


def selected(path: Column, globs: list[str]) -> Column:
    """Whether the last of the globs that matches includes the path (``!`` excludes); where none does, a path is in
    unless some glob includes."""
    chosen = F.lit(all(g.startswith("!") for g in globs))
    for g in globs:
        chosen = F.when(path.rlike(to_regex(g.removeprefix("!"))), not g.startswith("!")).otherwise(chosen)
    return chosen


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether ignore rules, as (folder of the rule, line), drop a path; the last one that matches decides."""
    out = F.lit(False)
    for folder, line in rules:
        line = line.rstrip("\n")
        if not line.strip() or line.startswith("#"):
            continue
        keep = line.startswith("!")
        rule = line[1:] if keep else line.removeprefix("\\")
        only_folder = rule.rstrip(" ").endswith("/")
        regex = to_regex(rule.rstrip(" "))
        if only_folder:
            regex = regex.removesuffix("(?:/.*)?$") + "/.*$"
        prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
        inside = F.substring(path, len(prefix) + 1, 1 << 30)
        hit = path.startswith(prefix) & inside.rlike(regex) if prefix else path.rlike(regex)
        out = F.when(hit, not keep).otherwise(out)
    return out
