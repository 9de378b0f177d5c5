"""Lua and Luau: functions, top-level variables, table fields, and Luau's types."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, normalised

SYNTAX = Syntax(("--",), (("--[==[", "]==]"), ("--[=[", "]=]"), ("--[[", "]]")), strings=(("[==[", "]==]", False), ("[=[", "]=]", False), ("[[", "]]", False), ("`", "`", True), ('"', '"', True), ("'", "'", True)), newline=True)
#: Metamethods by their kind (fixed values).
META = dict.fromkeys("__add __sub __mul __div __mod __pow __unm __idiv __band __bor __bxor __bnot __shl __shr __concat __len __eq __lt __le __call __tostring __pairs __ipairs".split(), "operator") | {"__index": "getter", "__newindex": "setter", "__gc": "destructor", "__close": "destructor"}
BLOCK = re.compile(r"\b(function|do|then|repeat|end|until|elseif|if)\b")


def lua(text: str) -> list:
    return _extract(text, False)


def luau(text: str) -> list:
    return _extract(text, True)


def _block_end(src: Source, at: int) -> int:
    """Behind the ``end`` of the function whose parameters end at ``at``."""
    depth = 1
    for m in BLOCK.finditer(src.code, at):
        if m[1] in ("function", "do", "then", "repeat"):
            depth += 1
        elif m[1] in ("end", "until"):
            depth -= 1
        elif m[1] == "elseif":
            depth -= 1
        if not depth:
            return m.end()
    return len(src.code)


def _parameters(src: Source, at: int, typed: bool) -> int:
    """Behind the parameter list (and, in Luau, the result's type)."""
    paren = re.compile(r"\s*(?:<[^>\n]*>)?\s*(?=\()").match(src.code, at)
    if not paren:
        return at
    end = min(src.match(paren.end(), len(src.code)) + 1, len(src.code))
    if typed and (m := re.compile(r"\s*:\s*").match(src.code, end)):
        i = m.end()
        while i < len(src.code) and src.code[i] != "\n":
            if src.code[i] in "({[":
                i = src.match(i, len(src.code))
            i += 1
        end = m.end() + len(src.code[m.end() : i].rstrip())
    return end


def _extract(text: str, typed: bool) -> list:
    src = Source(text, SYNTAX)
    code, at, n = src.code, 0, len(text)
    top = re.compile(r"(?P<function>(?:local\s+)?function\s+(?P<name>[\w.:]+))|(?P<type>(?:export\s+)?type\s+(?P<alias>\w+)\s*(?:<[^=]*>)?\s*=)|(?P<local>local\s+(?P<var>\w+)\s*(?P<attr><\s*\w+\s*>)?(?:\s*:[^=\n]*)?)(?=\s*=|\s*$|\s*\n)|(?P<global>^(?P<path>\w+(?:\.\w+)*)\s*)(?==(?!=))|(?P<skip>\b(?:do|then|repeat)\b)", re.M)
    while m := top.search(code, at):
        if m["skip"]:
            at = _block_end(src, m.end())
            continue
        if m["function"]:
            end = _parameters(src, m.end(), typed)
            close = _block_end(src, end)
            path, sign, last = m["name"].replace(":", ".").rpartition(".")
            kind = META.get(last or m["name"], "method" if ":" in m["name"] else "function")
            src.add(kind, m["name"].replace(":", "."), normalised(src.flat(m.start(), end)), m.start(), close)
            _inside(src, end, close, m["name"].replace(":", "."), typed)
            at = close
        elif m["type"]:
            if typed:
                end = _value_end(src, m.end())
                src.add("alias", m["alias"], src.first(m.start(), end), m.start(), end)
                at = end
            else:
                at = m.end()
        else:
            name = m["var"] or m["path"]
            equals = re.compile(r"\s*=\s*").match(code, m.end())
            end = _value_end(src, equals.end()) if equals else m.end()
            value = code[equals.end() : equals.end() + 9] if equals else ""
            if "." in name:
                if value.startswith("function"):
                    src.add(META.get(name.rpartition(".")[2], "function"), name, src.first(m.start(), end), m.start(), end)
                at = max(end, m.end())
                continue
            kind = "const" if m["attr"] and "const" in m["attr"] else "function" if value.startswith("function") else "var"
            src.add(kind, name, src.first(m.start(), end), m.start(), end)
            _inside(src, m.end(), end, "", typed)
            at = max(end, m.end())
    return src.out


def _inside(src: Source, a: int, b: int, scope: str, typed: bool) -> None:
    """Functions with a name and fields of tables, inside a function or a value."""
    at, found = a, re.compile(r"\{|(?:local\s+)?function\s+([\w.:]+)|\bfunction\b")
    while m := found.search(src.code, at, b):
        if m[0] == "{":
            close = src.match(m.start(), b)
            _table(src, m.end(), close, scope)
            at = close + 1
        elif m[1]:
            end = _parameters(src, m.end(), typed)
            close = _block_end(src, end)
            own = f"{scope}.{m[1]}".lstrip(".").replace(":", ".")
            src.add("method" if ":" in m[1] else "function", own, normalised(src.flat(m.start(), end)), m.start(), close)
            _inside(src, end, close, own, typed)
            at = close
        else:
            at = m.end()


def _value_end(src: Source, at: int) -> int:
    i, n = at, len(src.code)
    while i < n and src.code[i] != "\n":
        if src.code[i] in "({[":
            i = src.match(i, n)
        elif src.code.startswith("function", i) and not src.code[i - 1 : i].isalnum():
            i = _block_end(src, _parameters(src, i + 8, False)) - 1
        i += 1
    return min(i, n)


def _table(src: Source, a: int, b: int, scope: str) -> None:
    at = a
    while at < b:
        m = re.compile(r"[\s,;]*([A-Za-z_]\w*)\s*=(?!=)\s*").match(src.code, at, b)
        if not m:
            more = re.compile(r"[\s,;]*").match(src.code, at, b).end()
            at = min((x for x in (src.code.find(",", more, b), src.code.find(";", more, b)) if x >= 0), default=b) + 1 if more < b else b
            if more < b and src.code[more] in "([{":
                at = src.match(more, b) + 1
            continue
        begin, end = m.start(1), m.end()
        while end < b and src.code[end] not in ",;":
            if src.code[end] in "({[":
                end = src.match(end, b)
            elif src.code.startswith("function", end):
                end = _block_end(src, _parameters(src, end + 8, False)) - 1
            end += 1
        own, value = f"{scope}.{m[1]}".lstrip("."), src.code[m.end() : end]
        if value.startswith("{"):
            _table(src, m.end() + 1, src.match(m.end(), b), own)
        kind = META.get(m[1], "method") if value.startswith("function") else "field"
        src.add(kind, own, src.first(begin, end).rstrip(), begin, end)
        at = end + 1
