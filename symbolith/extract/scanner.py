"""What all extractors share: masking of comments and strings, statements by brackets, signatures and scopes.

A source is masked first: signs inside comments and strings become blanks of the same number, so brackets and keywords
of the code alone are left, at the same places.  Statements are then found by brackets and line ends.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and strings, and whether a line end can end a statement."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    nested: bool = False
    strings: tuple[tuple[str, str, bool], ...] = (('"', '"', True), ("'", "'", True))  # begin, end, escapes
    newline: bool = False
    patterns: bool = False  # between slashes


@dataclass
class Definition:
    kind: str
    line_start: int
    line_end: int
    scope: str
    signature: str


@dataclass
class Statement:
    """begin, end of the head, the body between its braces (-1 without one), end."""

    begin: int
    head: int
    open: int
    close: int
    end: int


@dataclass
class Source:
    text: str
    syntax: Syntax
    out: list[Definition] = field(default_factory=list)

    def __post_init__(self):
        self.code = mask(self.text, self.syntax)
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    # ---- signatures ----
    def flat(self, a: int, b: int) -> str:
        """Lines trimmed and joined by one space."""
        return " ".join(x for x in (line.strip() for line in self.text[a:b].split("\n")) if x)

    def first(self, a: int, b: int) -> str:
        return self.text[a:b].split("\n", 1)[0]

    def add(self, kind: str, scope: str, signature: str, a: int, b: int) -> None:
        last = max(a, b - 1)
        self.out.append(Definition(kind, self.line(a), self.line(last), scope, signature))

    # ---- statements ----
    def match(self, at: int, end: int) -> int:
        """Place of the bracket that closes the one at ``at``; ``end`` if none does."""
        depth = 0
        for m in re.compile(r"[(){}\[\]]").finditer(self.code, at, end):
            depth += 1 if m[0] in "({[" else -1
            if not depth:
                return m.start()
        return end

    def statements(self, a: int, b: int, not_body=None, tail=None):
        """Statements between two places.  One ends behind ``;``, behind the braces of its body, or, if the language
        has it so, at the end of a line that doesn't continue.  ``not_body(begin, at)``: these braces are part of the
        head.  ``tail(begin, at)``: behind its body, the statement still goes on to a ``;``."""
        code, i = self.code, a
        while i < b:
            while i < b and (code[i].isspace() or code[i] in ";,"):
                i += 1
            if i >= b:
                return
            begin, at, open_, close = i, i, -1, -1
            while at < b:
                c = code[at]
                if c in "([":
                    at = self.match(at, b)
                elif c == "{":
                    end = self.match(at, b)
                    if not_body and not_body(begin, at) or open_ >= 0:
                        at = end + 1
                        continue
                    open_, close, at = at, end, end + 1
                    if not (tail and tail(begin, at)):
                        break
                    continue
                elif c in ";}" or c == "\n" and self.syntax.newline and not self._continues(begin, at, b):
                    break
                at += 1
            at = min(at, b)
            end = at + 1 if at < b and code[at] == ";" else at
            head = open_ if open_ >= 0 else begin + len(code[begin:at].rstrip())
            yield Statement(begin, head, open_, close, end if open_ >= 0 or end > at else head)
            i = max(end, at + (at < b and code[at] == "}"), i + 1)

    def parts(self, a: int, b: int, separator: str = ","):
        """(begin, end) of what separators outside brackets divide, blanks trimmed."""
        at = a
        for i in [*self._outside(a, b, separator), b]:
            text = self.code[at:i]
            if text.strip():
                yield at + len(text) - len(text.lstrip()), at + len(text.rstrip())
            at = i + 1

    def _outside(self, a: int, b: int, sign: str):
        i = a
        while i < b:
            if self.code[i] in "([{":
                i = self.match(i, b)
            elif self.code[i] == sign:
                yield i
            i += 1

    def _continues(self, begin: int, at: int, b: int) -> bool:
        before = self.code[begin:at].rstrip()
        after = re.compile(r"\s*(\S{1,6})").match(self.code, at, b)
        if before.endswith((",", "=", "(", "+", "-", "*", "/", "|", "&", "->", "=>", ":", ".", "<", "extends", "implements", "where")) and not before.endswith(("++", "--")):
            return True
        return bool(after) and after[1].startswith((".", "{", "?.", "where ", "->", ":", "=", "&&", "||", "? ", "|", "throws", "rethro"))


def mask(text: str, syntax: Syntax) -> str:
    """The text with comments and what is inside strings blanked out; line ends stay."""
    marks = sorted([*syntax.line, *(o for o, _ in syntax.block), *(o for o, _, _ in syntax.strings)], key=len, reverse=True)
    if syntax.patterns:
        marks.append("/")
    if not marks:
        return text
    opener = re.compile("|".join(map(re.escape, marks)))
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    blocks, strings = dict(syntax.block), {o: (c, e) for o, c, e in syntax.strings}
    out, at = [], 0
    while m := opener.search(text, at):
        out.append(text[at : m.start()])
        mark, i = m[0], m.end()
        if mark in strings:
            close, escapes = strings[mark]
            if mark == "'" and "lifetime" in strings and not re.compile(r"'(\\.[^']*|[^'\\])'", re.S).match(text, m.start()):
                out.append("'")
                at = i
                continue
            while i < len(text) and not text.startswith(close, i):
                if escapes and text[i] == "\\":
                    i += 1
                elif text[i] == "\n" and len(close) == 1 and close != "`" and escapes and mark != "$'":
                    break
                i += 1
            i = min(i, len(text))
            end = min(len(text), i + len(close)) if text.startswith(close, i) else i
            out.append(mark + blank(text[m.end() : i]) + text[i:end])
            at = end
        elif syntax.patterns and mark == "/":
            end = _pattern_end(text, i) if _may_begin_value("".join(out[-4:])) else i
            out.append(re.sub(r"[^\n/]", " ", text[m.start() : end]) if end > i else mark)
            at = end
        elif mark in blocks:
            depth, i = 1, m.end()
            while i < len(text) and depth:
                if text.startswith(blocks[mark], i):
                    depth -= 1
                    i += len(blocks[mark])
                elif syntax.nested and text.startswith(mark, i):
                    depth += 1
                    i += len(mark)
                else:
                    i += 1
            out.append(blank(text[m.start() : i]))
            at = i
        else:
            end = text.find("\n", i)
            end = len(text) if end < 0 else end
            out.append(blank(text[m.start() : end]))
            at = end
    out.append(text[at:])
    return "".join(out)


def _may_begin_value(before: str) -> bool:
    """Whether a slash behind this masked text begins a pattern and doesn't divide."""
    before = before.rstrip()
    word = re.search(r"[\w$]+$", before)
    if word:
        return word[0] in ("return", "typeof", "case", "in", "of", "new", "delete", "void", "throw", "do", "else", "instanceof", "yield", "await")
    return not before or before[-1] in "([{,;=:!&|?+-*%>~^}"


def _pattern_end(text: str, at: int) -> int:
    """Place behind the pattern literal whose first sign is at ``at``; ``at`` itself if the line ends before it does."""
    inside, i = False, at
    while i < len(text) and text[i] != "\n":
        if text[i] == "\\":
            i += 1
        elif text[i] == "/" and not inside:
            return i + 1
        elif text[i] in "[]":
            inside = text[i] == "["
        i += 1
    return at


def normalised(signature: str) -> str:
    """White space collapsed; none before or behind an opening parenthesis, none before a closing one."""
    flat = re.sub(r"\s+", " ", signature).strip(" ")
    return re.sub(r" \)", ")", re.sub(r" ?\( ?", "(", flat))


def join(parent: str, name: str, separator: str) -> str:
    return f"{parent}{separator}{name}" if parent and name else parent or name
