"""C, C++ and Objective-C: declarations, types, members, macros."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join, normalised

SYNTAX = Syntax()
TYPE = re.compile(r"(?:typedef\s+|static\s+|extern\s+|const\s+|inline\s+)*(struct|union|enum(?:\s+(?:class|struct))?|class)\b\s*(?:__attribute__\s*\(\(.*?\)\)\s*|alignas\s*\([^)]*\)\s*|\[\[.*?\]\]\s*)*([\w:]*)")
FUNCTION = re.compile(r"(~?\w+|operator\s*(?:\(\s*\)|\[\s*\]|[^\s(\w]+|\w+(?:\s*[*&])*))\s*\(")
KEYWORDS = {"if", "for", "while", "switch", "return", "sizeof", "defined", "catch", "decltype", "alignas", "__attribute__", "noexcept", "throw", "requires", "static_assert", "typeof", "explicit"}


class Reader:
    def __init__(self, text: str, separator: str, plus: bool, objc: bool = False):
        self.src, self.sep, self.plus, self.objc = Source(text, SYNTAX), separator, plus, objc
        # directives aren't statements
        code = self.src.code
        for m in re.finditer(r"(?m)^[ \t]*#.*(?:\\\n.*)*", code):
            if d := re.match(r"[ \t]*#[ \t]*define[ \t]+(\w+)", m[0]):
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                self.src.add("macro", d[1], self.src.first(begin, m.end()).strip(), begin, m.end())
        self.src.code = re.sub(r"(?m)^[ \t]*#.*(?:\\\n.*)*", lambda m: re.sub(r"[^\n]", " ", m[0]), code)

    def full(self, a: int, b: int) -> str:
        return normalised(self.src.flat(a, b))

    def block(self, a: int, b: int, scope: str, owner: str | None = None) -> None:
        """``owner``: the type whose members these are, None outside types."""
        src = self.src
        tail = lambda begin, at: bool(re.match(r"(typedef|(static|extern|const)?\s*(struct|union|enum|class))\b", src.code[begin:at])) and not self._is_function(src.code[begin : src.code.find("{", begin)])
        not_body = lambda begin, at: bool(re.search(r"=\s*$", src.code[begin:at])) or self._initialised(src.code[begin:at])
        at = a
        while at < b:
            label = re.compile(r"\s*(public|private|protected|signals|slots)\s*:(?!:)").match(src.code, at, b)
            at = label.end() if label else at
            nxt = None
            for s in src.statements(at, b, not_body=not_body, tail=tail):
                self.statement(s, scope, owner)
                nxt = s.end
                if re.compile(r"\s*(public|private|protected)\s*:(?!:)").match(src.code, nxt, b):
                    break
            else:
                return
            at = nxt if nxt is not None and nxt > at else b

    def _initialised(self, head: str) -> bool:
        return self.plus and bool(re.search(r"\)\s*:\s*.*\w\s*$", head, re.S)) and bool(re.search(r"\b\w+$", head.rstrip())) and head.count(":") - 2 * head.count("::") > 0 and not re.search(r"\)\s*(const|noexcept|override)?\s*$", head)

    def _is_function(self, head: str) -> bool:
        m = FUNCTION.search(head)
        return bool(m) and m[1] not in KEYWORDS and "=" not in head[: m.start()]

    def statement(self, s, scope: str, owner: str | None) -> None:
        src, end = self.src, max(s.end, s.head)
        begin, code = s.begin, src.code[s.begin : s.head]
        body = s.open >= 0
        if self.plus:
            if m := re.match(r"template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*(?:requires\b.*?(?=\b(?:class|struct|void|auto|bool|int|T)\b))?", code, re.S):
                inner = type(s)(s.begin + m.end(), s.head, s.open, s.close, s.end)
                if c := re.match(r"\s*concept\s+(\w+)", code[m.end() :]):
                    src.add("concept", join(scope, c[1], self.sep), src.first(inner.begin, end), inner.begin, end)
                    return
                return self.statement(inner, scope, owner)
            if m := re.match(r"(inline\s+)?namespace\b\s*([\w:]*)\s*(=)?", code):
                if m[3]:
                    src.add("alias", join(scope, m[2], "::"), src.first(begin, end), begin, end)
                elif body:
                    own = join(scope, m[2], "::")
                    if m[2]:
                        src.add("namespace", own, self.full(begin, s.head), begin, end)
                    self.block(s.open + 1, s.close, own)
                return
            if body and re.match(r'extern\s*"[^"]*"\s*$', code):
                name = src.text[begin:s.head].split('"')[1]
                src.add("linkage", join(scope, name, "::"), self.full(begin, s.head), begin, end)
                return self.block(s.open + 1, s.close, join(scope, name, "::"))
            if m := re.match(r"using\s+(namespace\b)?\s*(\w+)?\s*(=)?", code):
                if not m[1]:
                    name = m[2] if m[3] else re.split(r"::", code.strip().rstrip(";"))[-1].strip()
                    src.add("alias", join(scope, name, "::"), src.first(begin, end), begin, end)
                return
            if re.match(r"friend\b|static_assert\b", code):
                return
        if self.objc and self._objc(s, code, scope):
            return
        m = TYPE.match(code)
        if code.startswith("typedef"):
            return self._typedef(s, m, scope)
        if m and not self._is_function(code) and (body or re.match(r"\s*(:[^:].*)?;?\s*$", code[m.end() :])):
            return self._type(s, m, scope, owner)
        if self._is_function(code):
            return self._function(s, code, scope, owner)
        self._variables(s, code, scope, owner)

    def _type(self, s, m, scope: str, owner: str | None) -> None:
        src, end, word = self.src, max(s.end, s.head), m[1].split()[0]
        name, body = m[2], s.open >= 0
        own = join(scope, name, self.sep) if self.plus or self.objc else name
        rest = src.code[s.close + 1 : s.end].strip(" \n\t;") if body else ""
        declared = re.match(r"\*?\s*(\w+)", rest)
        inner = join(scope, name, self.sep) if name else join(scope, declared[1], self.sep) if declared and self.plus else scope
        if name:
            signature = src.first(s.begin, end) if word == "enum" and body else self.full(s.begin, s.head if body else end).rstrip(";")
            src.add(word if body else f"{word}_declaration", own, signature, s.begin, end)
        if body and word == "enum":
            self._enumerators(s.open + 1, s.close, inner)
        elif body:
            self.block(s.open + 1, s.close, inner, inner.split(self.sep)[-1])
        if body and declared:
            kind = "field" if owner is not None else "var"
            src.add(kind, join(scope, declared[1], self.sep), src.first(s.begin, end) if kind == "var" or self.plus else src.flat(s.begin, end), s.begin, end)

    def _enumerators(self, a: int, b: int, scope: str) -> None:
        for x, y in self.src.parts(a, b):
            if m := re.match(r"\w+", self.src.code[x:y]):
                self.src.add("variant", join(scope, m[0], self.sep), self.src.first(x, y) if self.plus else self.src.flat(x, y), x, y)

    def _typedef(self, s, m, scope: str) -> None:
        src, end = self.src, max(s.end, s.head)
        code = src.code[s.begin : end]
        after = src.code[s.close + 1 : end] if s.open >= 0 else code
        pointer = re.search(r"\(\s*[*^]\s*(\w+)\s*\)", after)
        name = pointer[1] if pointer else (re.findall(r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?:\([^)]*\))?\s*;?\s*$", after) or [""])[0]
        if not name:
            return
        own = join(scope, name, self.sep) if self.plus or self.objc else name
        if s.open >= 0 and m:
            word = m[1].split()[0]
            src.add("alias" if self.plus and word != "enum" else word, own, src.first(s.begin, end), s.begin, end)
            if m[2] and self.plus:
                src.add(word, join(scope, m[2], self.sep), self.full(s.begin + code.find(word), s.head), s.begin, end)
            inner = join(scope, m[2], self.sep) if m[2] and self.plus else own
            if word == "enum":
                self._enumerators(s.open + 1, s.close, inner)
            else:
                self.block(s.open + 1, s.close, inner, inner)
        else:
            src.add("alias", own, src.first(s.begin, end), s.begin, end)

    def _function(self, s, code: str, scope: str, owner: str | None) -> None:
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        m = next(f for f in FUNCTION.finditer(code) if f[1] not in KEYWORDS)
        before = code[: m.start()].rstrip()
        if re.search(r"\(\s*\*\s*$", code[: m.start()]) or code[m.end() :].lstrip().startswith("*") and re.match(r"\s*\*\s*\w+\s*\)\s*\(", code[m.end() :]) and not self.plus:
            return self._variables(s, code, scope, owner)
        qualified = re.search(r"((?:\w+(?:<[^<>]*>)?\s*::\s*)+)$", code[: m.start()])
        path = re.sub(r"<[^<>]*>|\s", "", qualified[1])[:-2] if qualified else ""
        name = re.sub(r"\s+", "", m[1]) if not re.match(r"operator\s+\w", m[1]) else " ".join(m[1].split())
        kind = "method" if (owner is not None or path) and self.plus else "function"
        own = join(join(scope, path, "::"), name, self.sep)
        if self.plus:
            result = re.sub(r"\b(explicit|virtual|inline|constexpr|static|friend|consteval|noexcept)\b|\[\[.*?\]\]", "", (code[: qualified.start()] if qualified else before)).strip()
            if name.startswith("~"):
                kind, own = "destructor", join("" if path else scope, name, "::")
            elif name.startswith("operator"):
                kind = "operator"
            elif not result and (owner == name or path.split("::")[-1] == name):
                kind = "constructor"
        definition = body or bool(re.search(r"=\s*(default|delete)\s*;?\s*$", code))
        signature = self.full(s.begin, s.head if body else end)
        src.add(kind if definition else f"{kind}_declaration", own, signature, s.begin, end)

    def _variables(self, s, code: str, scope: str, owner: str | None) -> None:
        src, end = self.src, max(s.end, s.head)
        if not re.match(r"[\w:<>*&\s,\[\]()~^]+", code) or re.match(r"(return|goto|break|case|default|if|else|for|while|do|switch|using|throw|delete)\b", code):
            return
        whole = src.code[s.begin : end].rstrip().rstrip(";")
        if not re.search(r"\w[\s*&>]+[\w(]", whole) and not re.search(r"\w+\s+\w+", whole):
            return
        constant, external = bool(re.search(r"\b(const|constexpr)\b", re.split("=", whole)[0])), whole.startswith("extern") and "=" not in whole
        for k, (x, y) in enumerate(src.parts(s.begin, s.begin + len(whole))):
            part = re.split(r"=|\{", src.code[x:y])[0]
            pointer = re.search(r"\(\s*[*^&]\s*(?:const\s+)?(\w+)", part)
            names = [pointer[1]] if pointer else re.findall(r"(\w+)\s*(?:\[[^\]]*\]\s*)*(?::\s*\d+\s*)?$", part.strip())
            if not names:
                continue
            kind = "field" if owner is not None else "const" if constant else "var"
            kind = f"{kind}_declaration" if external and kind != "field" else kind
            signature = src.flat(s.begin, end) if kind == "field" and not self.plus else src.first(s.begin, end)
            src.add(kind, join(scope, names[0], self.sep), signature, s.begin, end)

    # ---- Objective-C ----
    def _objc(self, s, code: str, scope: str) -> bool:
        return bool(re.match(r"@", code))


def c(text: str) -> list:
    r = Reader(text, "::", False)
    r.block(0, len(text), "")
    return sorted(r.src.out, key=lambda d: d.line_start)


def cplusplus(text: str) -> list:
    r = Reader(text, "::", True)
    r.block(0, len(text), "")
    return sorted(r.src.out, key=lambda d: d.line_start)


def objc(text: str) -> list:
    r = Reader(text, ".", False, True)
    src, code = r.src, r.src.code
    for m in re.finditer(r"@(class|protocol)\s+([\w\s,]+);|@(interface|implementation|protocol)[ \t]+(\w+)[ \t]*(\([^)]*\))?[^\n{]*", code):
        if m[1] == "class":
            for name in re.findall(r"\w+", m[2]):
                src.add("class_declaration", name, normalised(src.flat(m.start(), m.end())), m.start(), m.end())
            continue
        if m[1]:
            continue
        close = code.find("@end", m.end())
        close = len(code) if close < 0 else close
        name = m[4]
        category = m[5].strip("() ") if m[5] is not None else None
        own = name if not category else f"{name}.{category}"
        kind = "protocol" if m[3] == "protocol" else "extension" if category is not None else "class"
        src.add(kind, own, normalised(m[0] and src.flat(m.start(), m.end())), m.start(), close + 4)
        at = m.end()
        if code[at:].lstrip().startswith("{"):
            brace = code.find("{", at)
            r.block(brace + 1, src.match(brace, close), own, own)
            at = src.match(brace, close) + 1
        for p in re.finditer(r"@property\b[^;]*;|^[ \t]*[-+]\s*\([^;{]*[;{]", code[at:close], re.M):
            x, y = at + p.start() + len(p[0]) - len(p[0].lstrip()), at + p.end()
            if p[0].startswith("@property"):
                prop = re.findall(r"(\w+)\s*(?:\[[^\]]*\])?\s*;", p[0])
                block = re.search(r"\(\s*\^\s*(\w+)", p[0])
                src.add("property", f"{own}.{block[1] if block else prop[0]}", src.first(x, y), x, y)
            else:
                first = re.match(r"[-+]\s*\([^)]*(?:\([^)]*\)[^)]*)*\)\s*(\w+)", p[0].lstrip())
                body = p[0].endswith("{")
                if first:
                    src.add("method" if body else "method_declaration", f"{own}.{first[1]}", normalised(src.flat(x, y - body)), x, src.match(y - 1, close) + 1 if body else y)
    for m in re.finditer(r"typedef\s+NS_(?:ENUM|OPTIONS)\s*\(\s*[^,]+,\s*(\w+)\s*\)\s*\{", code):
        src.add("enum", m[1], src.first(m.start(), m.end()), m.start(), src.match(m.end() - 1, len(code)) + 1)
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    src.code = re.sub(r"typedef\s+NS_(?:ENUM|OPTIONS)\s*\([^)]*\)\s*\{[^}]*\}[^;]*;|@(?:interface|implementation|protocol)\b(?![^\n;]*;).*?@end|@(?:class|protocol|import)[^;]*;", blank, code, flags=re.S)
    r.block(0, len(src.code), "")
    return sorted(src.out, key=lambda d: d.line_start)
