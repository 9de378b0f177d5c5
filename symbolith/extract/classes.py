"""Java, C#, Kotlin, Swift, PHP and Dart: types with members, in braces."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join, normalised

NAME = r"[\w$`]+"


class Reader:
    """What the languages share; each gives its syntax, and reads one statement."""

    syntax, separator = Syntax(), "."

    def __init__(self, text: str):
        self.src = Source(text, self.syntax)

    def run(self) -> list:
        self.block(0, len(self.src.text), "", None)
        return self.src.out

    def full(self, a: int, b: int) -> str:
        return normalised(self.src.flat(a, b))

    def line(self, a: int, b: int) -> str:
        return normalised(self.src.first(a, b))

    def not_body(self, begin: int, at: int) -> bool:
        return bool(re.search(r"(=|\bnew\s+[\w<>\[\], ]*(\([^)]*\))?|=>|\breturn|[(\[,])\s*$", self.src.code[begin:at]))

    def after(self, begin: int, end: int) -> int:
        """Where the declaration begins behind annotations, attributes or decorators."""
        code, at = self.src.code, begin
        while True:
            m = re.compile(r"\s*(@(?!interface)[\w.:]+|#?\[)").match(code, at, end)
            if not m:
                return at + len(code[at:end]) - len(code[at:end].lstrip())
            if m[1].endswith("["):
                at = self.src.match(m.end() - 1, end) + 1
            else:
                at = m.end()
                paren = re.compile(r"\(").match(code, at)
                at = self.src.match(at, end) + 1 if paren else at

    def block(self, a: int, b: int, scope: str, owner) -> str:
        for s in self.src.statements(a, b, not_body=self.not_body, tail=self.tail):
            at = self.after(s.begin, max(s.head, s.begin))
            new = self.statement(s, at, self.src.code[at : max(at, s.head)], scope, owner)
            scope = scope if new is None else new
        return scope

    def tail(self, begin: int, at: int) -> bool:
        return False

    def statement(self, s, at: int, code: str, scope: str, owner) -> str | None:
        raise NotImplementedError


class Java(Reader):
    MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|native|synchronized|default|strictfp|transient|volatile|sealed|non-sealed)\s+|@\w+(?:\([^)]*\))?\s*)*"

    def statement(self, s, at, code, scope, owner):
        src, end = self.src, max(s.end, s.head)
        if m := re.match(r"package\s+([\w.]+)", code):
            src.add("package", m[1], self.line(s.begin, end), s.begin, end)
        elif m := re.match(r"(?:open\s+)?module\s+([\w.]+)", code):
            src.add("module", m[1], src.flat(s.begin, s.head), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"(class|interface|enum|record|@interface)\s+(\w+)", code):
            kind, own = "annotation" if m[1][0] == "@" else m[1], join(scope, m[2], ".")
            src.add(kind, own, src.first(s.begin, end) if kind == "annotation" else src.flat(s.begin, s.head), s.begin, end)
            at = s.open + 1
            if kind == "enum":
                at = self.constants(at, s.close, own)
            if s.open >= 0:
                self.block(at, s.close, own, (m[2], kind))
        elif owner and (m := re.match(self.MODIFIERS + r"(?:<[^(]*>\s+)?(?:([\w.<>\[\],?& ]+?)\s+)?(\w+)\s*(\(|\{)", code + ("{" if s.open >= 0 else ""))) and (m[3] == "(" or owner[1] == "record" and m[2] == owner[0]) and "=" not in code[: m.start(3)]:
            own, body = join(scope, m[2], "."), s.open >= 0
            if owner[1] == "annotation":
                return src.add("method_declaration", own, self.line(s.begin, end), s.begin, end)
            kind = "constructor" if not m[1] and m[2] == owner[0] else "method"
            src.add(kind if body else f"{kind}_declaration", own, self.full(s.begin, s.head).rstrip(";").rstrip(), s.begin, end)
        elif owner and s.open < 0 and (m := re.match(self.MODIFIERS + r"[\w.<>\[\],?& ]+?\s+(\w+)\s*(?:\[\s*\])*\s*(=|,|;|$)", code)):
            head = re.split("=", code)[0]
            kind = "const" if owner[1] == "interface" or re.search(r"\bstatic\b", head) and re.search(r"\bfinal\b", head) else "field"
            for name in [m[1], *(re.match(r"\w+", src.code[x:y])[0] for x, y in list(src.parts(at, s.head))[1:] if m[2] == "," and re.match(r"\w+", src.code[x:y]))]:
                src.add(kind, join(scope, name, "."), src.first(s.begin, end), s.begin, end)
        return None

    def constants(self, a: int, b: int, scope: str) -> int:
        stop = next(iter(self.src._outside(a, b, ";")), b)
        for x, y in self.src.parts(a, stop):
            at = self.after(x, y)
            if m := re.match(r"\w+", self.src.code[at:y]):
                own = join(scope, m[0], ".")
                comma = self.src.code[y : y + 1] == ","
                self.src.add("variant", own, self.src.first(x, y), x, y + comma - comma)
                brace = re.compile(r"\w+\s*(\([^{]*\))?\s*\{").match(self.src.code, at, y)
                if brace:
                    self.block(brace.end(), self.src.match(brace.end() - 1, y), own, (m[0], "class"))
        return min(stop + 1, b)


class CSharp(Reader):
    syntax = Syntax(("//", "#"), strings=(('@"', '"', False), ('$"', '"', True), ('"', '"', True), ("'", "'", True)))
    MODIFIERS = r"(?:(?:public|protected|private|internal|static|readonly|abstract|sealed|virtual|override|async|extern|unsafe|partial|new|ref|volatile|required|file)\s+)*"
    TYPE = r"[\w.<>\[\],?* ()]+?"

    def not_body(self, begin, at):
        return super().not_body(begin, at) or bool(re.search(r"=(?!>)[^=]*$", self.src.code[begin:at])) and "operator" not in self.src.code[begin:at]

    def tail(self, begin, at):
        return bool(re.match(r"\s*=(?!=)", self.src.code[at:]))

    def statement(self, s, at, code, scope, owner):
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        if m := re.match(r"namespace\s+([\w.]+)", code):
            own = join(scope, m[1], ".")
            src.add("namespace", own, self.full(s.begin, s.head if body else end), s.begin, end)
            if not body:
                return own
            self.block(s.open + 1, s.close, own, None)
        elif m := re.match(self.MODIFIERS + r"(class|interface|struct|enum|record(?:\s+(?:struct|class))?)\s+(\w+)", code):
            kind, own = ("struct" if m[1].endswith("struct") else m[1].split()[0]), join(scope, m[2], ".")
            src.add(kind, own, self.full(s.begin, s.head if body else end), s.begin, end)
            if kind == "enum":
                for x, y in src.parts(s.open + 1, s.close):
                    if v := re.match(r"\w+", src.code[self.after(x, y) : y]):
                        src.add("variant", join(own, v[0], "."), self.full(x, y), x, y)
            elif body:
                self.block(s.open + 1, s.close, own, (m[2], kind))
        elif m := re.match(self.MODIFIERS + r"delegate\s+" + self.TYPE + r"\s+(\w+)\s*(?:<[^>]*>)?\s*\(", code):
            src.add("delegate", join(scope, m[1], "."), self.full(s.begin, end).rstrip(";"), s.begin, end)
        elif owner:
            self.member(s, at, code, scope, owner, end, body)
        return None

    def member(self, s, at, code, scope, owner, end, body):
        src = self.src
        arrow = code.find("=>")
        head = s.begin + (at - s.begin) + arrow if arrow >= 0 and (not body or at + arrow < s.open) else s.head
        inside = body or arrow >= 0
        if m := re.match(self.MODIFIERS + r"event\s+" + self.TYPE + r"\s+(\w+)", code):
            src.add("event", join(scope, m[1], "."), self.full(s.begin, s.head if body else end).rstrip(";"), s.begin, end)
        elif m := re.match(r"~(\w+)\s*\(", code):
            src.add("destructor", join(scope, m[1], "."), self.full(s.begin, head), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"(?:(implicit|explicit)\s+operator\s+([\w<>?]+)|" + self.TYPE + r"\s+operator\s*(true|false|[^\s\w(]+))\s*\(", code):
            name = f"{m[1]} operator {m[2]}" if m[1] else f"operator{m[3]}"
            src.add("operator" if inside else "operator_declaration", join(scope, name, "."), self.full(s.begin, head) if inside else src.first(s.begin, end), s.begin, end)
        elif m := re.match(self.MODIFIERS + self.TYPE + r"\s+this\s*\[", code):
            src.add("subscript", join(scope, "this", "."), self.full(s.begin, end), s.begin, end)
            self.accessors(s, join(scope, "this", "."), body)
        elif m := re.match(self.MODIFIERS + r"(?:(" + self.TYPE + r")\s+)?(?:\w+\.)*(\w+)\s*(?:<[^()=]*>)?\s*\(", code):
            if m[2] in ("if", "for", "while", "return"):
                return
            kind = "constructor" if not m[1] and m[2] == owner[0] else "method"
            src.add(kind if inside else f"{kind}_declaration", join(scope, m[2], "."), self.full(s.begin, head) if inside else src.first(s.begin, end), s.begin, end)
        elif (body or arrow >= 0) and (m := re.match(self.MODIFIERS + self.TYPE + r"\s+(?:\w+\.)*(\w+)\s*(=>|$)", code)):
            own = join(scope, m[1], ".")
            src.add("property", own, self.full(s.begin, end), s.begin, end)
            self.accessors(s, own, body)
        elif not body and (m := re.match(self.MODIFIERS + r"(const\s+)?" + self.TYPE + r"\s+(\w+)\s*(=|;|,|$)", code)):
            equals = at + m.start(3) if m[1] and m[3] == "=" else end
            more = [re.match(r"\w+", src.code[x:y]) for x, y in list(src.parts(at, s.head))[1:]] if m[3] in ("=", ",") else []
            for name in [m[2], *(x[0] for x in more if x)]:
                src.add("const" if m[1] else "field", join(scope, name, "."), self.full(s.begin, equals).rstrip(";"), s.begin, end)

    def accessors(self, s, own, body):
        src = self.src
        for t in src.statements(s.open + 1, s.close) if body else ():
            if a := re.match(r"(?:(?:public|protected|private|internal|readonly)\s+)*(get|set)\b", src.code[t.begin : max(t.head, t.begin)]):
                src.add({"get": "getter", "set": "setter"}[a[1]], own, src.first(t.begin, max(t.end, t.head)), t.begin, max(t.end, t.head))


class Php(Reader):
    syntax = Syntax(("//", "#!"), strings=(('"', '"', True), ("'", "'", True)))
    separator = "\\"
    MAGIC = {"__construct": "constructor", "__destruct": "destructor", "__set": "setter"} | dict.fromkeys(["__get", "__isset", "__unset"], "getter") | dict.fromkeys(["__invoke", "__call", "__callStatic"], "operator")

    def __init__(self, text):
        super().__init__(text)
        # what is outside the tags is no code
        self.src.code = re.sub(r"\A.*?<\?(?:php\b|=)|\?>.*?(?:<\?(?:php\b|=)|\Z)|(?m:#(?!\[).*$)", lambda m: re.sub(r"[^\n]", " ", m[0][:-1]) + (";" if m[0][:2] == "?>" else " "), self.src.code, flags=re.S) if "<?" in text else self.src.code

    def statement(self, s, at, code, scope, owner):
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        stop = s.head if body else end - (src.code[end - 1 : end] == ";")
        modifiers = r"(?:(?:public|protected|private|static|abstract|final|readonly|var)\s+)*"
        sep = "::" if owner else "\\"
        if m := re.match(r"namespace\s+([\w\\]+)?", code):
            if m[1]:
                src.add("namespace", m[1], self.line(s.begin, end) if not body else self.full(s.begin, s.head), s.begin, end)
            if not body:
                return m[1] or ""
            self.block(s.open + 1, s.close, m[1] or "", None)
        elif m := re.match(modifiers + r"(class|interface|trait|enum)\s+(\w+)", code):
            own = join(scope, m[2], "\\")
            src.add(m[1], own, self.full(s.begin, s.head), s.begin, end)
            self.block(s.open + 1, s.close, own, (m[2], m[1]))
        elif m := re.match(modifiers + r"function\s*&?\s*(\w+)\s*\(", code):
            own = join(scope, m[1], sep)
            kind = self.MAGIC.get(m[1], "method") if owner else "function"
            src.add(kind if body or not owner else f"{kind}_declaration", own, self.full(s.begin, stop), s.begin, end)
            if kind == "constructor":
                paren = at + m.end() - 1
                for x, y in src.parts(paren + 1, src.match(paren, end)):
                    if p := re.match(r"(?:(?:public|protected|private|readonly)\s+)+[^$]*\$(\w+)", src.code[x:y]):
                        src.add("property", join(scope, p[1], "::"), self.full(x, y), x, y)
        elif m := re.match(modifiers + r"const\s+(?:[\w\\|?]+\s+)?(\w+)\s*=", code):
            more = [re.match(r"\w+(?=\s*=)", src.code[x:y]) for x, y in list(src.parts(at, stop))[1:]]
            for name in [m[1], *(x[0] for x in more if x)]:
                src.add("const", join(scope, name, sep), self.full(s.begin, stop), s.begin, end)
        elif m := re.match(r"case\s+(\w+)", code) if owner else None:
            src.add("variant", join(scope, m[1], "::"), self.full(s.begin, stop), s.begin, end)
        elif not owner and (m := re.match(r"\\?define\s*\(\s*['\"]", code)):
            name = re.match(r"\\?define\s*\(\s*['\"]([^'\"]+)", src.text[at:end])
            src.add("const", join(scope, name[1], "\\"), self.full(s.begin, stop), s.begin, end)
        elif owner and (m := re.match(r"(?:(?:public|protected|private|static|readonly|var)\s+)+[^$(]*\$(\w+)", code)):
            src.add("property", join(scope, m[1], "::"), self.line(s.begin, end), s.begin, end)
        return None


class Kotlin(Reader):
    syntax = Syntax(nested=True, strings=(('"""', '"""', False), ('"', '"', True), ("'", "'", True)), newline=True)
    MODIFIERS = r"(?:(?:public|private|protected|internal|open|abstract|final|sealed|data|inner|value|inline|suspend|override|operator|infix|tailrec|external|const|lateinit|companion|enum|annotation|expect|actual|fun(?=\s+interface)|noinline|crossinline|vararg)\s+)*"

    def not_body(self, begin, at):
        code = self.src.code[begin:at]
        return bool(re.match(r"\s*(?:@\S+\s+)*" + self.MODIFIERS + r"(val|var)\b", code)) or bool(re.search(r"=\s*[^=]*$", code)) and bool(re.search(r"\bfun\b", code))

    def statement(self, s, at, code, scope, owner):
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        if m := re.match(r"package\s+([\w.]+)", code):
            src.add("package", m[1], self.line(s.begin, end), s.begin, end)
        elif m := re.match(r"(" + self.MODIFIERS + r")(class|interface|object)\b\s*(" + NAME + ")?", code):
            name = m[3] or ("Companion" if "companion" in m[1] else "")
            own = join(scope, name, ".")
            kind = "enum" if re.search(r"\benum\b", m[1]) else "annotation" if "annotation" in m[1] else m[2]
            if m[3]:
                src.add(kind, own, self.full(s.begin, s.head), s.begin, end)
            if body:
                first = s.open + 1
                if kind == "enum":
                    first = self.constants(first, s.close, own)
                self.block(first, s.close, own, (name, kind))
            paren = re.compile(r"\s*(?:<[^>]*>)?\s*(?:(?:@\w+|private|public|protected|internal)\s+)*(?:constructor\s*)?\(").match(src.code, at + m.end(), s.head) if m[3] and kind != "interface" else None
            if paren:
                close = src.match(paren.end() - 1, s.head)
                begin = paren.start() + len(paren[0]) - len(paren[0].lstrip())
                src.add("constructor", own, self.full(paren.end() - 1 if "constructor" not in paren[0] else begin, close + 1), begin, close + 1)
                for x, y in src.parts(paren.end(), close):
                    if p := re.match(r"(?:@\w+\s+)*" + self.MODIFIERS + r"(?:val|var)\s+(" + NAME + ")", src.code[x:y]):
                        src.add("property", join(own, p[1], "."), self.line(x, y), x, y)
        elif m := re.match(r"(" + self.MODIFIERS + r")fun\s+(?:<[^>]*>\s*)?(?:[\w<>?,. ]+\.)?(" + NAME + r")\s*\(", code):
            kind = "operator" if "operator" in m[1] else "method" if owner else "function"
            equals = re.search(r"(?<![=!<>])=(?!=)", code[self.close_of(code, m.end() - 1) :]) if not body else None
            defined = body or equals
            head = at + self.close_of(code, m.end() - 1) + equals.start() if equals else s.head
            src.add(kind if defined else f"{kind}_declaration", join(scope, m[2].strip("`"), "."), self.full(s.begin, head), s.begin, end)
        elif m := re.match(r"(" + self.MODIFIERS + r")(val|var)\s+(?:<[^>]*>\s*)?(?:\(([^)]*)\)|(?:[\w<>?]+\.)?(" + NAME + "))", code):
            names = re.findall(r"\w+(?=\s*(?:[:,]|$))", m[3]) if m[3] else [m[4].strip("`")]
            kind = "const" if "const" in m[1] or not owner and m[2] == "val" else "property" if owner else "var"
            for name in names:
                src.add(kind, join(scope, name, "."), self.line(s.begin, end), s.begin, end)
            self.last = join(scope, names[-1], ".") if names else scope
        elif m := re.match(self.MODIFIERS + r"(get|set)\s*(\(|$)", code):
            src.add({"get": "getter", "set": "setter"}[m[1]], getattr(self, "last", scope), src.first(s.begin, end), s.begin, end)
        elif owner and (m := re.match(self.MODIFIERS + r"constructor\s*\(", code)):
            src.add("constructor", scope, self.full(s.begin, s.head), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"typealias\s+(\w+)", code):
            src.add("alias", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        return None

    @staticmethod
    def close_of(code: str, at: int) -> int:
        depth = 0
        for i in range(at, len(code)):
            depth += (code[i] in "([{") - (code[i] in ")]}")
            if not depth:
                return i + 1
        return len(code)

    def constants(self, a, b, scope):
        stop = next(iter(self.src._outside(a, b, ";")), b)
        for x, y in self.src.parts(a, stop):
            at = self.after(x, y)
            if m := re.match(r"(\w+)\s*(\(|\{|$)", self.src.code[at:y]):
                self.src.add("variant", join(scope, m[1], "."), self.line(x, y), x, y)
                brace = self.src.code.find("{", at, y)
                if brace >= 0:
                    self.block(brace + 1, self.src.match(brace, y), join(scope, m[1], "."), (m[1], "class"))
        return min(stop + 1, b)


class Swift(Reader):
    syntax = Syntax(nested=True, strings=(('"""', '"""', True), ('"', '"', True)), newline=True)
    MODIFIERS = r"(?:(?:public|private|fileprivate|internal|open|static|class(?=\s+(?:func|var|let))|final|override|mutating|nonmutating|lazy|weak|unowned|required|convenience|indirect|prefix|postfix|infix|dynamic|optional|nonisolated|isolated|distributed|async|private\(set\)|public\(set\)|internal\(set\)|fileprivate\(set\)|unowned\(\w+\))\s+)*"

    def not_body(self, begin, at):
        return bool(re.search(r"=\s*$", self.src.code[begin:at]))

    def statement(self, s, at, code, scope, owner):
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        protocol = bool(owner) and owner[1] == "protocol"
        if m := re.match(self.MODIFIERS + r"(class|struct|enum|actor|extension|protocol)\s+([\w.]+)", code):
            own = join(scope, m[2], ".")
            src.add(m[1], own, self.full(s.begin, s.head), s.begin, end)
            if body:
                self.block(s.open + 1, s.close, own, (m[2], m[1]))
        elif m := re.match(self.MODIFIERS + r"func\s+(" + NAME + r"|[^\s\w(]+)\s*(?:<[^(]*>)?\s*\(", code):
            name = m[1].strip("`")
            kind = "operator" if not re.match(r"\w", name) else "method" if owner else "function"
            src.add(f"{kind}_declaration" if protocol and not body else kind, join(scope, name, "."), self.full(s.begin, s.head), s.begin, end)
        elif owner and (m := re.match(self.MODIFIERS + r"(init|deinit|subscript)\b[?!]?", code)):
            kind = {"init": "constructor", "deinit": "destructor", "subscript": "subscript"}[m[1]]
            src.add(f"{kind}_declaration" if protocol else kind, join(scope, m[1], "."), self.full(s.begin, s.head), s.begin, end)
        elif owner and (m := re.match(r"(?:indirect\s+)?case\s+(.*)", code, re.S)) and owner[1] in ("enum", "extension"):
            for x, y in src.parts(at + m.start(1), s.head):
                if v := re.match(NAME, src.code[x:y]):
                    src.add("variant", join(scope, v[0].strip("`"), "."), self.line(s.begin, end), s.begin, end)
        elif m := re.match(r"associatedtype\s+(\w+)", code):
            src.add("associated_type", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"typealias\s+(\w+)", code):
            src.add("alias", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"macro\s+(\w+)", code):
            src.add("macro", join(scope, m[1], "."), self.full(s.begin, s.head), s.begin, end)
        elif m := re.match(self.MODIFIERS + r"(let|var)\s+(" + NAME + ")", code):
            kind = "property_declaration" if protocol else "const" if m[1] == "let" else "property" if owner else "var"
            src.add(kind, join(scope, m[2].strip("`"), "."), self.line(s.begin, end), s.begin, end)
        elif m := re.match(r"(?:prefix|postfix|infix)\s+operator\s+(\S+?)(?=\s|:|$)", code):
            src.add("operator_declaration", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        elif m := re.match(r"precedencegroup\s+(\w+)", code):
            src.add("operator", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        return None


class Dart(Reader):
    syntax = Syntax(nested=True, strings=(("'''", "'''", True), ('"""', '"""', True), ('"', '"', True), ("'", "'", True)))
    TYPE = r"(?:[\w.]+(?:<[^;={}]*?>)?\??|\([^)]*\)\??)"

    def not_body(self, begin, at):
        return bool(re.search(r"(=|=>[^{]*|\breturn|[(\[,?:])\s*$", self.src.code[begin:at]))

    def statement(self, s, at, code, scope, owner):
        src, end, body = self.src, max(s.end, s.head), s.open >= 0
        if m := re.match(r"library\s+([\w.]+)", code):
            src.add("module", m[1], self.line(s.begin, end), s.begin, end)
        elif re.match(r"(import|export|part)\b", code):
            return None
        elif m := re.match(r"((?:(?:abstract|sealed|base|final|interface|mixin)\s+)*)class\s+(\w+)|(?:base\s+)?mixin\s+(\w+)|enum\s+(\w+)|extension\s+type\s+(?:const\s+)?(\w+)|extension\s+(\w+)?", code):
            name = next((x for x in m.groups()[1:] if x), "")
            kind = "class" if m[2] else "mixin" if m[3] else "enum" if m[4] else "extension_type" if m[5] else "extension"
            own = join(scope, name, ".")
            if name and name != "on":
                src.add(kind, own, self.full(s.begin, s.head if body else end).rstrip(";"), s.begin, end)
                for word in ("mixin", "interface"):
                    if m[1] and re.search(rf"\b{word}\b", m[1]):
                        src.add(word, own, self.full(s.begin, s.head), s.begin, end)
            if body:
                first = s.open + 1
                if kind == "enum":
                    stop = next(iter(src._outside(first, s.close, ";")), s.close)
                    for x, y in src.parts(first, stop):
                        if v := re.match(r"\w+", src.code[self.after(x, y) : y]):
                            src.add("variant", join(own, v[0], "."), self.line(x, y), x, y)
                    first = min(stop + 1, s.close)
                self.block(first, s.close, own, (name, kind))
        elif m := re.match(r"typedef\s+(?:[\w<>?]+\s+)?(\w+)", code):
            src.add("alias", join(scope, m[1], "."), self.line(s.begin, end), s.begin, end)
        else:
            self.member(s, at, code, scope, owner, end, body)
        return None

    def member(self, s, at, code, scope, owner, end, body):
        src = self.src
        arrow = re.search(r"=>", code)
        head = at + arrow.start() if arrow else s.head
        plain = code[: arrow.start()] if arrow else code
        inside = body or bool(arrow)
        prefix = r"(?:(?:external|static|abstract|augment)\s+)*"
        signature = self.full(s.begin, head).rstrip(";").rstrip()
        if m := re.match(prefix + r"(?:" + self.TYPE + r"\s+)?(get|set)\s+(\w+)", plain):
            src.add({"get": "getter", "set": "setter"}[m[1]], join(scope, m[2], "."), self.line(s.begin, head).rstrip(";").rstrip(), s.begin, end)
        elif m := re.match(prefix + self.TYPE + r"\s+operator\s*(\[\]=?|==|[^\s\w(]+)\s*\(", plain):
            src.add("operator", join(scope, f"operator{m[1]}", "."), signature, s.begin, end)
        elif owner and (m := re.match(r"(?:(?:const|factory|external)\s+)*(" + re.escape(owner[0]) + r"(?:\.\w+)?)\s*\(", plain)):
            named = m[1].partition(".")[2]
            initial = bool(named) and re.match(r"\s*:", src.code[src.match(at + m.end() - 1, end) + 1 : end])
            stop = head if initial else src.match(at + m.end() - 1, end) + 1
            src.add("constructor", join(scope, named, ".") if named else join(scope, m[1], "."), self.full(s.begin, stop).rstrip(";"), s.begin, end)
        elif (m := re.match(prefix + r"(?:" + self.TYPE + r"\s+)?(\w+)\s*(?:<[^()=]*>)?\s*\(", plain)) and "=" not in plain[: m.end()]:
            kind = "method" if owner else "function"
            cut = src.match(at + m.end() - 1, end) + 1
            src.add(kind if inside or not owner else f"{kind}_declaration", join(scope, m[1], "."), self.full(s.begin, cut), s.begin, end)
        elif m := re.match(r"((?:(?:static|late|final|const|var|external|abstract|covariant)\s+)*)(?:" + self.TYPE + r"\s+)?(\w+)\s*(=|,|;|$)", plain):
            kind = "const" if "const" in m[1] or not owner and "late" in m[1] and "final" in m[1] else "field" if owner else "var"
            name = at + m.start(2)
            stop = end - (src.code[end - 1 : end] == ";")
            src.add(kind, join(scope, m[2], "."), self.line(name, stop), name, end)


def reader(kind: type[Reader]):
    return lambda text: kind(text).run()
