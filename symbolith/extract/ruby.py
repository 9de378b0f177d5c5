"""Ruby: modules, classes, methods and what macros define, by their ``end`` keywords."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join, normalised

SYNTAX = Syntax(("#",), (("\n=begin", "\n=end"),), strings=(('"', '"', True), ("'", "'", True)), newline=True)
OPERATORS = set("+ - * / % ** == != < > <= >= <=> === [] []= << >> ! =~ !~ & | ^ ~ +@ -@ call to_s to_str coerce each".split()) - {"call", "to_s", "to_str", "coerce", "each"}
OPEN = re.compile(r"(?:^|[;=(]|\bbegin\b)\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")


def extract(text: str) -> list:
    src = Source(text, SYNTAX)
    code, stack = src.code, []  # (scope, kind, index of the definition or -1)
    at = 0
    for raw in code.split("\n"):
        line, begin = raw.strip(), at + len(raw) - len(raw.lstrip())
        end = at + len(raw.rstrip())
        scope = next((x for x, _, _ in reversed(stack) if x is not None), "")
        where = stack[-1][1] if stack else "top"
        opened = _one(src, line, begin, end, scope, where)
        opens = 1 if OPEN.search(line) else 0
        one_line = bool(re.search(r"\bend\s*$", line)) and opens or re.match(r"def\s+[^=]*\)\s*=\s|def\s+\w+[?!]?\s*=\s", line)
        closes = len(re.findall(r"(?<![.\w:])end(?![\w?!:])", line))
        if opens and not one_line:
            stack.append(opened or (None, "block", -1))
        elif not opens and closes and stack:
            for _ in range(closes):
                _, _, index = stack.pop() if stack else (None, None, -1)
                if index >= 0:
                    src.out[index].line_end = src.line(end)
        at += len(raw) + 1
    return src.out


def _body(src: Source, begin: int, end: int) -> int:
    """Where the first statement of a body begins; behind its ``end`` if it is empty."""
    rest = src.code[end:]
    at = end + len(rest) - len(rest.lstrip())
    return at + 3 if re.match(r"end\b", src.code[at:]) else at


def _one(src: Source, line: str, begin: int, end: int, scope: str, where: str):
    """Adds what a line defines; what it opens, if that is a definition."""
    sign = lambda stop=end: normalised(src.flat(begin, stop))
    if where == "def":
        return None
    if m := re.match(r"(class|module)\s+(?:(<<)\s*\w+|([A-Z][\w:]*))", line):
        if m[2]:
            return scope, "class", -1
        own = join(scope, m[3], "::")
        src.add(m[1], own, sign(_body(src, begin, end)), begin, end)
        return own, m[1], len(src.out) - 1
    if m := re.match(r"(?:(?:private|protected|public|module_function|private_class_method)\s+)?def\s+(?:self\.|\w+\.)?([\w]+[?!=]?(?=[\s(;]|$)|\[\]=?|[^\s\w(]+)", line):
        name = m[1]
        kind = "operator" if name in OPERATORS else "constructor" if name == "initialize" else "method"
        start = begin + line.index("def")
        stop = begin + (re.search(r";|\)\s*=\s", line).start() + (line[re.search(r";|\)\s*=\s", line).start()] == ")") if re.search(r";|\)\s*=\s", line) else len(line))
        stop = _body(src, begin, end) if stop == begin + len(line) else stop
        src.add(kind, join(scope, name, "::"), normalised(src.flat(start, stop)), begin, end)
        return join(scope, name, "::"), "def", len(src.out) - 1
    if where in ("def", "block"):
        return None
    raw = src.text[begin:end]
    if m := re.match(r"([A-Z]\w*)\s*=\s*(Struct\.new|Data\.define)\b", line):
        own = join(scope, m[1], "::")
        src.add("struct", own, src.first(begin, end), begin, end)
        return own, "class", len(src.out) - 1
    if m := re.match(r"([A-Z]\w*)\s*(?:\|\||&&|[-+*/])?=(?![=~])", line):
        src.add("const", join(scope, m[1], "::"), sign(begin + len(re.match(r"\w+", line)[0])), begin, end)
    elif where == "top" and (m := re.match(r"([a-z_]\w*)\s*(?:\|\||&&|[-+*/])?=(?![=~])", line)):
        src.add("var", m[1], sign(begin + len(m[1])), begin, end)
    elif m := re.match(r"alias\s+:?(\S+)\s+:?\S+", line) or re.match(r"alias_method\s*\(?\s*:(\S+?)\s*,", line):
        src.add("alias", join(scope, m[1], "::"), src.first(begin, end), begin, end)
    elif m := re.match(r"attr_(reader|writer|accessor)\b(.*)", line):
        for name in re.findall(r":(\w+[?!]?)", raw):
            own = join(scope, name, "::")
            src.add("property", own, src.first(begin, end), begin, end)
            if m[1] != "writer":
                src.add("getter", own, src.first(begin, end), begin, end)
            if m[1] != "reader":
                src.add("setter", own, src.first(begin, end), begin, end)
    elif m := re.match(r"define_(?:singleton_)?method\s*\(?\s*:?[\"']?(\w+[?!=]?)", raw):
        src.add("method", join(scope, m[1], "::"), src.first(begin, end), begin, end)
        return join(scope, m[1], "::"), "def", len(src.out) - 1
    return None
