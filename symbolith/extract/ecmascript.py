"""JavaScript and TypeScript: declarations, classes, object literals and, for TypeScript, types."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join

SYNTAX = Syntax(strings=(("`", "`", True), ('"', '"', True), ("'", "'", True)), newline=True, patterns=True)
MODIFIERS = r"(?:(?:export|default|declare|abstract|async|static|public|private|protected|readonly|override|accessor)\s+)*"
DECLARED = re.compile(MODIFIERS + r"(function\b\s*\*?|class\b|interface\b|type\b|enum\b|const\s+enum\b|namespace\b|module\b|const\b|let\b|var\b)\s*((?:[\w$]+\.)*[\w$]+|\"[^\"]*\"|'[^']*')?")
MEMBER = re.compile(r"((?:(?:static|public|private|protected|readonly|override|abstract|async|declare|accessor)\s+(?![(=:;?!]))*)((?:get|set)\s+(?![(=:;?]))?(\*\s*)?(#?[\w$]+|\"[^\"]*\"|'[^']*'|\[[^\]]*\])?\s*([?!])?\s*(<|\(|:|=(?!>)|;|$)", re.S)
FUNCTION = re.compile(r"(async\s+)?(function\b|(\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)\s*(:\s*[^=]+)?=>)", re.S)


def javascript(text: str) -> list:
    return _extract(text, False)


def typescript(text: str) -> list:
    return _extract(text, True)


def _extract(text: str, typed: bool) -> list:
    src = Source(text, SYNTAX)
    _statements(src, 0, len(text), "", typed)
    return src.out


def _statements(src: Source, a: int, b: int, scope: str, typed: bool) -> None:
    value = lambda begin, at: bool(re.match(MODIFIERS + r"(const(?!\s+enum)|let|var|type)\b", src.code[begin:at]))
    for s in src.statements(a, b, not_body=value):
        begin, code = s.begin, src.code[s.begin : s.head]
        while m := re.match(r"@[\w.]+", code):  # decorators
            begin += m.end()
            if src.code[begin : begin + 1] == "(":
                begin = src.match(begin, b) + 1
            begin += len(src.code[begin:b]) - len(src.code[begin:b].lstrip())
            code = src.code[begin : max(begin, s.head)]
        m = DECLARED.match(code)
        if not m or not m[2]:
            continue
        word, name = re.sub(r"\W", "", m[1]) if not m[1].startswith("const") else m[1].strip(), m[2].strip("\"'")
        if m[2][0] in "\"'":
            name = src.text[begin + m.start(2) : begin + m.end(2)].strip("\"'")
        ambient = typed and bool(re.match(r"(export\s+)?declare\s", code))
        own = join(scope, name, ".")
        end = max(s.end, s.head)
        if word == "function":
            signature = re.sub(r"^declare\s+", "", src.flat(s.begin, end)) if ambient else src.flat(s.begin, s.head)
            src.add("function" if s.open >= 0 else "function_declaration", own, signature, s.begin, end)
        elif word == "class":
            src.add("class_declaration" if ambient else "class", own, src.flat(s.begin, s.head), s.begin, end)
            _class(src, s.open + 1, s.close, own, typed)
        elif word in ("const", "let", "var"):
            _variables(src, begin + m.end(1), s.begin, max(s.end, s.head), word, scope, ambient, typed)
        elif typed and word == "interface":
            src.add("interface", own, src.flat(s.begin, s.head), s.begin, end)
            _interface(src, s.open + 1, s.close, own)
        elif typed and word == "type" and re.match(r"\s*(<|=)", src.code[begin + m.end() : end]):
            src.add("alias", own, src.flat(s.begin, end), s.begin, end)
        elif typed and word in ("enum", "const enum"):
            src.add("enum_declaration" if ambient else "enum", own, src.flat(s.begin, s.head), s.begin, end)
            for x, y in src.parts(s.open + 1, s.close):
                if v := re.match(r"[\w$]+|\"[^\"]*\"|'[^']*'", src.text[x:y]):
                    src.add("variant", join(own, v[0].strip("\"'"), "."), src.first(x, y), x, y)
        elif typed and word in ("namespace", "module") and s.open >= 0:
            src.add("module_declaration" if m[2][0] in "\"'" else "namespace", own, re.sub(r"^declare\s+(?=module)", "", src.flat(s.begin, s.head)), s.begin, end)
            _statements(src, s.open + 1, s.close, own, typed)


def _variables(src: Source, a: int, begin: int, b: int, word: str, scope: str, ambient: bool, typed: bool) -> None:
    stop = b - (src.code[b - 1 : b] == ";")
    for k, (x, y) in enumerate(src.parts(a, stop)):
        m = re.match(r"[\w$]+", src.code[x:y])
        if not m:
            continue
        own = join(scope, m[0], ".")
        equals = re.compile(r"[^=]*?(?<![=!<>])=(?![=>])\s*", re.S).match(src.code, x, y)
        value = equals.end() if equals else y
        rest = src.code[value:y]
        if FUNCTION.match(rest) and word != "var":
            kind = "function"
        elif rest.startswith("class") and word != "var":
            kind = "class"
        else:
            kind = "var" if word in ("let", "var") else "const"
        kind = f"{kind}_declaration" if ambient and kind in ("const", "var") else kind
        src.add(kind, own, src.flat(begin if not k else x, y), begin if not k else x, y)
        if kind == "class" and (brace := src.code.find("{", value, y)) >= 0:
            _class(src, brace + 1, src.match(brace, y), own, typed)
        elif rest.startswith("{") and word != "var":
            _object(src, value + 1, src.match(value, y), own, typed)


def _object(src: Source, a: int, b: int, scope: str, typed: bool) -> None:
    for x, y in src.parts(a, b):
        code = src.code[x:y]
        m = re.match(r"(async\s+)?(\*\s*)?((?:get|set)\s+(?![:(,]))?([\w$]+|\"[^\"]*\"|'[^']*')\s*(\(|:)", code)
        if not m:
            continue
        raw = src.text[x + m.start(4) : x + m.end(4)].strip("\"'")
        own = join(scope, raw, ".")
        if m[5] == "(":
            brace = src.code.find("{", src.match(x + m.end() - 1, y), y)
            src.add(_method(m[4], m[3]), own, src.flat(x, brace if brace >= 0 else y), x, y)
            continue
        value = x + m.end() + len(src.code[x + m.end() : y]) - len(src.code[x + m.end() : y].lstrip())
        rest = src.code[value:y]
        if f := FUNCTION.match(rest):
            brace = src.code.find("{", value + f.end(), y)
            src.add("method", own, src.flat(x, brace if brace >= 0 else y), x, y)
        elif rest.startswith("class"):
            src.add("class", own, src.flat(x, src.code.find("{", value, y)), x, y)
        else:
            src.add("field", own, src.first(x, y), x, y)
            if rest.startswith("{"):
                _object(src, value + 1, src.match(value, y), own, typed)


def _method(name: str, accessor: str | None) -> str:
    return "constructor" if name == "constructor" else {"get": "getter", "set": "setter"}.get((accessor or "").strip(), "method")


def _class(src: Source, a: int, b: int, scope: str, typed: bool) -> None:
    field = lambda begin, at: bool(re.match(r"[^({]*(?<![=!<>])[=:](?!=)[^(]*$|[^({]*=", src.code[begin:at])) and not re.match(r"[^=({]*\([^{]*\)\s*(:[^{=]*)?$", src.code[begin:at])
    for s in src.statements(a, b, not_body=field):
        begin, code = s.begin, src.code[s.begin : max(s.head, s.begin)]
        while m := re.match(r"@[\w.]+", code):
            begin += m.end()
            if src.code[begin : begin + 1] == "(":
                begin = src.match(begin, b) + 1
            begin += len(src.code[begin:b]) - len(src.code[begin:b].lstrip())
            code = src.code[begin : max(begin, s.head)]
        m = MEMBER.match(code)
        if not m or not m[4] or code.startswith("static {"):
            continue
        name, end = src.text[begin + m.start(4) : begin + m.end(4)].strip("\"'"), max(s.end, s.head)
        own = join(scope, name, ".")
        if m[6] in ("(", "<"):
            if m[4].startswith("[") and not typed:
                continue
            kind = _method(m[4], m[2])
            body = s.open >= 0
            src.add(kind if body or not typed else f"{kind}_declaration", own, src.flat(s.begin, s.head).rstrip(";"), s.begin, end)
        elif m[4].startswith("["):
            if typed:
                src.add("subscript_declaration", own, src.first(s.begin, end).rstrip(";"), s.begin, end)
        else:
            src.add("field", own, src.first(s.begin, end).rstrip(";"), s.begin, end)


def _interface(src: Source, a: int, b: int, scope: str) -> None:
    for s in src.statements(a, b, not_body=lambda begin, at: True):
        code, end = src.code[s.begin : s.head], max(s.end, s.head)
        signature = src.first(s.begin, end).rstrip().rstrip(";,")
        if m := re.match(r"new\s*(<[^>]*>)?\s*\(", code):
            src.add("constructor_declaration", join(scope, "new", "."), signature, s.begin, end)
        elif re.match(r"(<[^>]*>)?\s*\(", code):
            src.add("method_declaration", join(scope, "call", "."), signature, s.begin, end)
        elif m := re.match(r"(?:readonly\s+)?(\[[^\]]*\])", code):
            src.add("subscript_declaration", join(scope, src.text[s.begin + m.start(1) : s.begin + m.end(1)], "."), signature, s.begin, end)
        elif m := re.match(r"((?:get|set)\s+(?![(:?]))?([\w$]+|\"[^\"]*\"|'[^']*')\??\s*(<[^(]*>)?\s*\(", code):
            src.add(f"{_method(m[2], m[1])}_declaration", join(scope, m[2], "."), src.flat(s.begin, end).rstrip().rstrip(";,"), s.begin, end)
        elif m := re.match(r"(?:readonly\s+)?([\w$]+|\"[^\"]*\"|'[^']*')\??\s*:", code):
            src.add("property_declaration", join(scope, src.text[s.begin + m.start(1) : s.begin + m.end(1)].strip("\"'"), "."), signature, s.begin, end)
