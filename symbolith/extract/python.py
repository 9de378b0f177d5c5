"""Python: logical lines and an indentation stack."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join

SYNTAX = Syntax(("#",), (), strings=(('"""', '"""', True), ("'''", "'''", True), ('"', '"', True), ("'", "'", True)), newline=True)
ENUMS = {"Enum", "IntEnum", "StrEnum", "Flag", "IntFlag"}
#: Methods with a kind of their own (fixed values).
SPECIAL = {"__init__": "constructor", "__new__": "constructor", "__del__": "destructor"} | dict.fromkeys(["__getitem__", "__setitem__", "__delitem__", "__missing__"], "subscript")
OPERATORS = "add radd iadd sub rsub isub mul rmul imul truediv rtruediv itruediv floordiv rfloordiv ifloordiv mod rmod imod divmod rdivmod pow rpow ipow matmul rmatmul imatmul and rand iand or ror ior xor rxor ixor lshift rlshift ilshift rshift rrshift irshift neg pos abs invert eq ne lt le gt ge contains call len bool int float complex index round trunc floor ceil iter next reversed hash str repr bytes format enter exit".split()


def _logical_lines(src: Source):
    """(begin, end) of statements that stand on lines of their own; brackets and backslashes join lines."""
    at, n = 0, len(src.code)
    while at < n:
        depth, i = 0, at
        while i < n:
            c = src.code[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            elif c == "\n" and depth <= 0 and src.code[i - 1 : i] != "\\":
                break
            i += 1
        if src.code[at:i].strip():
            yield at, i
        at = i + 1


def extract(text: str) -> list:
    src = Source(text, SYNTAX)
    lines = [(a + len(src.code[a:b]) - len(src.code[a:b].lstrip()), b, len(re.match(r"[ \t]*", src.code[a:b])[0].expandtabs(8))) for a, b in _logical_lines(src)]
    stack: list[tuple[int, str, str]] = []  # indentation, scope, "def" | "class" | "enum"
    decorators, names = -1, []
    for k, (a, b, indent) in enumerate(lines):
        code = src.code[a:b]
        if code.startswith("@"):
            decorators = a if decorators < 0 else decorators
            names.append(code[1:].strip())
            continue
        while stack and indent <= stack[-1][0]:
            stack.pop()
        scope = stack[-1][1] if stack else ""
        in_class = next((kind for _, _, kind in reversed(stack) if kind in ("class", "enum")), None)
        begin = decorators if decorators >= 0 else a
        if m := re.match(r"(?:async\s+)?def\s+(\w+)|class\s+(\w+)", code):
            colon = _colon(src, a, b)
            end = _block_end(lines, k, indent, b, src)
            signature = src.flat(begin, _body_begin(src, lines, k, colon, b))
            signature = signature[:-1].rstrip() if signature.endswith(":") else signature
            name = m[1] or m[2]
            own = join(scope, name, ".")
            if m[1]:
                src.add(_callable(name, names) if scope else "function", own, signature, begin, end)
                stack.append((indent, own, "def"))
            else:
                kind = _class_kind(code)
                src.add(kind, own, signature, begin, end)
                stack.append((indent, own, "enum" if kind == "enum" else "class"))
                if src.code[colon + 1 : b].strip():
                    stack.pop()
        elif m := re.match(r"type\s+(\w+)\s*(\[[^=]*\])?\s*=", code):
            src.add("alias", join(scope, m[1], "."), src.flat(a, _trimmed(src, a, b)), a, b)
        elif m := re.match(r"(\w+)\s*(?::([^=]+))?(=(?!=)|$)", code):
            if not (m[2] or m[3]) or m[1] in ("pass", "return", "break", "continue", "else", "try", "finally") and not m[3]:
                pass
            elif m[2] and m[2].strip() in ("TypeAlias", "typing.TypeAlias"):
                src.add("alias", join(scope, m[1], "."), src.flat(a, _trimmed(src, a, b)), a, b)
            else:
                stop = a + m.start(3) if m[3] else _trimmed(src, a, b)
                if in_class:
                    src.add("variant" if in_class == "enum" and stack[-1][2] == "enum" else "field", join(scope, m[1], "."), src.flat(a, stop), a, b)
                elif not stack:
                    src.add("var", m[1], src.flat(a, stop), a, b)
        decorators, names = -1, []
    return src.out


def _trimmed(src: Source, a: int, b: int) -> int:
    return a + len(src.code[a:b].rstrip())


def _colon(src: Source, a: int, b: int) -> int:
    depth = 0
    for i in range(a, b):
        c = src.code[i]
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and not depth:
            return i
    return b


def _body_begin(src: Source, lines: list, k: int, colon: int, b: int) -> int:
    """Where the block starts: behind the colon on the same line, else at the next statement (comments between count)."""
    rest = src.code[colon + 1 : b]
    if rest.strip():
        return colon + 1 + len(rest) - len(rest.lstrip())
    return lines[k + 1][0] if k + 1 < len(lines) and lines[k + 1][2] > lines[k][2] else b


def _block_end(lines: list, k: int, indent: int, b: int, src: Source) -> int:
    end = _trimmed(src, lines[k][0], b)
    for a, b_, deeper in lines[k + 1 :]:
        if deeper <= indent:
            break
        end = _trimmed(src, a, b_)
    return end


def _callable(name: str, decorators: list[str]) -> str:
    for d in decorators:
        if d == "property" or d.endswith(".getter"):
            return "getter"
        if d.endswith((".setter", ".deleter")):
            return "setter"
    if name in SPECIAL:
        return SPECIAL[name]
    return "operator" if name[:2] == name[-2:] == "__" and name[2:-2] in OPERATORS else "method"


def _class_kind(code: str) -> str:
    m = re.match(r"class\s+\w+\s*(?:\[[^\]]*\])?\s*\((.*)\)", code, re.S)
    for base in re.split(r",(?![^\[(]*[\])])", m[1]) if m else []:
        last = re.sub(r"\[.*", "", base.strip(), flags=re.S).split(".")[-1]
        if last in ENUMS:
            return "enum"
        if last == "Protocol":
            return "protocol"
    return "class"
