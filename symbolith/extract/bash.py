"""Bash: functions, read-only variables and top-level assignments."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join, normalised

SYNTAX = Syntax((), (), strings=(('"', '"', True), ("'", "'", False)), newline=True)
LINE = re.compile(r"[ \t]*(?:(?P<function>function\s+(?P<name>[\w:.-]+)\s*(?:\(\s*\))?|(?P<plain>[\w:.-]+)\s*\(\s*\))\s*(?P<open>[{(])|(?P<const>readonly|(?:declare|typeset|local)\s+-\w*r\w*)\b(?P<rest>[^\n;]*)|(?P<var>[A-Za-z_]\w*)(?:\[[^\]]*\])?\+?=)", re.M)


#: A here-document: its mark, the rest of that line, its text up to the mark on a line of its own.
HERE = re.compile(r"(?<!<)<<(-?)[ \t]*(['\"]?)(\w+)\2(?![\w<])([^\n]*\n)(.*?)(?=^\t*\3[ \t]*$|\Z)", re.M | re.S)


def extract(text: str) -> list:
    text = HERE.sub(lambda m: m[0][: len(m[0]) - len(m[5])] + re.sub(r"[^\n]", " ", m[5]), text)
    text = re.sub(r"(?m)(^|\s)#.*", lambda m: m[1] + " " * (len(m[0]) - len(m[1])), text)
    src = Source(text, SYNTAX)
    _block(src, 0, len(text), "")
    return src.out


def _block(src: Source, a: int, b: int, scope: str) -> None:
    at, depth = a, 0
    while at < b:
        m = LINE.match(src.code, at, b)
        if m and m["function"]:
            begin = at + len(m[0]) - len(m[0].lstrip())
            close = src.match(m.end() - 1, b)
            own = join(scope, m["name"] or m["plain"], "::")
            src.add("function", own, normalised(src.flat(begin, m.start("open"))), begin, close + 1)
            _block(src, m.end(), close, own)
            at = close + 1
            continue
        if m and m["const"]:
            begin = at + len(m[0]) - len(m[0].lstrip())
            for x in re.finditer(r"(?<![\w=$-])([A-Za-z_]\w*)(=\S*)?", m["rest"]):
                stop = m.start("rest") + (x.start(2) if x[2] else x.end())
                src.add("const", join(scope, x[1], "::"), normalised(src.flat(begin, stop)) if x[2] else src.first(begin, m.end()).strip(), begin, m.end())
        elif m and m["var"] and not scope and not depth:
            begin = m.start("var")
            src.add("var", m["var"], normalised(src.flat(begin, src.code.find("=", begin))).rstrip("+"), begin, m.end())
        end = src.code.find("\n", at, b)
        line = src.code[at : b if end < 0 else end]
        depth += len(re.findall(r"\b(if|for|while|until|case|select)\b(?=\s)", line)) - len(re.findall(r"\b(fi|done|esac)\b", line))
        at = b if end < 0 else end + 1
