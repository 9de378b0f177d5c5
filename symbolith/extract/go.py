"""Go: declarations of the top level, grouped ones too."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, normalised

SYNTAX = Syntax(strings=(("`", "`", False), ('"', '"', True), ("'", "'", True)), newline=True)


def extract(text: str) -> list:
    src = Source(text, SYNTAX)
    in_head = lambda a, at: bool(re.search(r"\b(interface|struct)\s*$", src.code[a:at])) and src.code[a : a + 4] == "func"
    for s in src.statements(0, len(text), not_body=in_head):
        head = src.code[s.begin : s.head]
        if m := re.match(r"package\s+(\w+)", head):
            src.add("package", m[1], normalised(src.first(s.begin, s.end)), s.begin, s.end)
        elif m := re.match(r"func\s+(?:\(\s*(?:\w+\s+)?\*?\s*([\w.]+)[^)]*\)\s*)?(\w+)", head):
            src.add("method" if m[1] else "function", f"{m[1]}.{m[2]}" if m[1] else m[2], src.flat(s.begin, s.head), s.begin, s.end)
        elif m := re.match(r"(type|const|var)\b\s*", head):
            at = s.begin + m.end()
            if src.code[at] == "(":
                close = src.match(at, len(text))
                for t in src.statements(at + 1, close):
                    _spec(src, m[1], t.begin, t.end, s.begin)
            else:
                _spec(src, m[1], at, max(s.end, s.head), s.begin)
    return src.out


def _spec(src: Source, word: str, a: int, b: int, whole: int) -> None:
    code = src.code[a:b]
    if word != "type":
        m = re.match(r"\w+(\s*,\s*\w+)*", code)
        for name in re.findall(r"\w+", m[0]) if m else ():
            if name != "_":
                src.add(word, name, src.text[a:b].rstrip(), a, b)
        return
    m = re.match(r"(\w+)\s*(\[[^\]]*\w[^\]]*\s+[^\]]*\])?\s*(=)?\s*(struct|interface)?\b", code)
    if not m:
        return
    name, kind = m[1], m[4] if not m[3] else None
    brace = src.code.find("{", a + m.end(), b) if kind else -1
    if brace < 0:
        src.add("alias", name, src.first(whole if m[3] else a, b), a, b)
        return
    src.add(kind, name, src.flat(a, brace), a, b)
    for t in src.statements(brace + 1, src.match(brace, b)):
        line, end = src.code[t.begin : t.end], max(t.end, t.head)
        if kind == "interface":
            if x := re.match(r"(\w+)\s*\(", line):
                src.add("method_declaration", f"{name}.{x[1]}", src.text[t.begin : end].rstrip(), t.begin, end)
            continue
        raw = src.text[t.begin : end].rstrip().rstrip(";").rstrip()
        if x := re.match(r"\*?\s*(?:\w+\.)?(\w+)(\[[^\]]*\])?\s*(`|\"|$)", line):
            src.add("field", f"{name}.{x[1]}", raw, t.begin, end)
        elif x := re.match(r"\w+(\s*,\s*\w+)*", line):
            for field in re.findall(r"\w+", x[0]):
                src.add("field", f"{name}.{field}", raw, t.begin, end)
