"""Name patterns: analysis on the driver, and the predicate that Spark evaluates.

A pattern is a regular expression that is searched for anywhere in a scope.  It is read into alternatives, each a flat
sequence of steps, and two questions are asked of them: does every name match (then there is no predicate), and does
each alternative need a sign that no name has (an error).  What the engine's dialect doesn't have (look-around,
back-references, possessive quantifiers) is an error too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import any_of

META = set(".*+?|()[]{}\\^$")
#: What stands for all code points in the class tests.
_SAMPLE = [*range(0x20, 0x7F), 0x09, 0x0A, *range(0xA0, 0x250), 0x391, 0x3B1, 0x416, 0x436, 0x5D0, 0x627, 0x660, 0x905, 0x4E2D, 0x3042, 0xAC00, 0x1F600, 0x2028]
_WORD = [chr(c) for c in _SAMPLE if re.match(r"\w", chr(c))]


class Case(Enum):
    SENSITIVE = "sensitive"
    INSENSITIVE = "insensitive"
    SMART = "smart"


class Signs(Enum):
    """How many of the signs that names consist of a step of a pattern takes."""

    NONE, SOME, ALL = range(3)


class Step(NamedTuple):
    """One step of a sequence, reduced to what the two questions need.

    ``needed``: a match must take a sign here.  ``idle``: beside other steps it puts no condition on a name.
    ``boundary``: a word boundary, which counts as a step without signs once it is captured or repeated.
    """

    signs: Signs
    needed: bool = True
    idle: bool = False
    boundary: bool = False


class Group(NamedTuple):
    """Alternatives in parentheses, each a sequence of steps."""

    alternatives: list[list[Step]]
    captured: bool

    def as_step(self) -> Step:
        """The group as one step of a sequence."""
        if len(self.alternatives) == len(self.alternatives[0]) == 1:
            only = self.alternatives[0][0]
            signs = Signs.NONE if only.boundary or only.needed and only.signs is Signs.NONE else only.signs
        else:
            signs = Signs.NONE if all(map(hopeless, self.alternatives)) else Signs.SOME
        return Step(signs, idle=self.captured and signs is Signs.ALL)


def hopeless(sequence: list[Step]) -> bool:
    """Whether the sequence needs a sign that no name has."""
    return any(s.needed and s.signs is Signs.NONE for s in sequence)


def unconditional(sequence: list[Step]) -> bool:
    """Whether every name matches: a lone step that takes all signs (however often), or idle ones side by side."""
    return sequence[0].signs is Signs.ALL if len(sequence) == 1 else len(sequence) > 1 and all(s.idle for s in sequence)


class _Parser:
    """Reads as much of the dialect as the questions need; whatever it doesn't know is a literal."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def alternatives(self) -> list[list[Step]]:
        begin, found = self.at, self.sequence()
        while self.peek() == "|":
            self.at += 1
            found += self.sequence()
        # single signs side by side are one class
        if len(found) > 1 and re.fullmatch(r"(\\[^\w\s]|[^\\()\[\]{}.*+?^$|])(\|(\\[^\w\s]|[^\\()\[\]{}.*+?^$|]))+", source := self.text[begin : self.at]):
            return [[Step(_signs_of("[" + "".join(re.escape(c.removeprefix("\\")) for c in source.split("|")) + "]"))]]
        return found

    def sequence(self) -> list[list[Step]]:
        """One sequence, or the alternatives of a group that stands alone."""
        items: list[Step | Group] = []
        while self.at < len(self.text) and self.peek() not in "|)":
            item = self.item()
            if item is not None:
                items.append(self.repeated(item))
        if len(items) == 1 and isinstance(items[0], Group):
            return list(items[0].alternatives)
        steps: list[Step] = []
        for item in items:
            if isinstance(item, Group) and not item.captured and len(item.alternatives) == 1:
                steps += item.alternatives[0]
            else:
                steps.append(item.as_step() if isinstance(item, Group) else item)
        return [steps]

    def repeated(self, item: Step | Group) -> Step | Group:
        while got := re.match(r"([*+?]|\{(\d+)(,(\d*))?\})([?+]?)", self.text[self.at :]):
            if got[5] == "+":
                raise ValueError("invalid regex pattern: possessive quantifiers are not supported")
            self.at += got.end()
            if got[1][0] == "{":
                least = int(got[2])
                most = least if got[3] is None else int(got[4]) if got[4] else None
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[got[1]]
            if (least, most) == (1, 1):
                continue
            signs = (item if isinstance(item, Group) else Group([[item]], False)).as_step().signs
            if most == 0 or signs is Signs.NONE and not least:
                signs = Signs.SOME
            item = Step(signs, needed=least > 0, idle=signs is Signs.ALL and (least, most) == (0, None))
        return item

    def item(self) -> Step | Group | None:
        c = self.peek()
        if c == "(":
            return self.group()
        if c == "[":
            end = _class_end(self.text, self.at)
            text, self.at = self.text[self.at : end], end
            return Step(_signs_of(text))
        self.at += 1
        if c == ".":
            return Step(Signs.ALL)
        edge = Step(Signs.SOME, needed=False, idle=True)
        if c in "^$":
            return edge
        if c != "\\":
            return Step(Signs.SOME)
        got = re.match(r"b\{[a-z-]+\}|[pP](\{[^}]*\}|.)|x\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|[uU]\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|.", self.text[self.at :], re.S)
        if not got:
            raise ValueError("invalid regex pattern: incomplete escape")
        self.at += got.end()
        escape = got[0]
        if escape[0].isdigit() or escape[0] == "k":
            raise ValueError("invalid regex pattern: backreferences are not supported")
        if escape[0] in "QEZG":
            raise ValueError(f"invalid regex pattern: unrecognized escape \\{escape[0]}")
        if escape[0] in "dDwWsSpP":
            return Step(_signs_of("\\" + escape))
        if escape[0] in "bBAz":
            return edge._replace(boundary=escape in ("b", "B"))
        return Step(Signs.SOME)

    def group(self) -> Group | None:
        rest = self.text[self.at :]
        if re.match(r"\(\?(<?[=!]|>)", rest):
            raise ValueError("invalid regex pattern: look-around and atomic groups are not supported")
        captured = True
        if got := re.match(r"\(\?([a-zA-Z-]*)([:)])", rest):
            self.at += got.end()
            if got[2] == ")":
                return None
            captured = False
        elif got := re.match(r"\(\?P?<\w+>", rest):
            self.at += got.end()
        else:
            self.at += 1
        inner = self.alternatives()
        if self.peek() != ")":
            raise ValueError("invalid regex pattern: unclosed group")
        self.at += 1
        return Group(inner, captured)


def _class_end(text: str, at: int) -> int:
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 2
            continue
        if text[i] == "[":
            depth += 1
            if text[i + 1 : i + 2] == "^":
                i += 1
            if text[i + 1 : i + 2] == "]":
                i += 1
        elif text[i] == "]":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    raise ValueError("invalid regex pattern: unclosed character class")


def _signs_of(text: str) -> Signs:
    """Of a class.  A class of one sign is a literal, which is never questioned."""
    source = re.sub(r"\\[pP]\{?\^?(\w+)\}?", lambda m: r"[^\W\d_]" if m[0][1] == "p" else r"[\W\d_]", text)
    for name, members in (("alpha", "a-zA-Z"), ("digit", "0-9"), ("alnum", "a-zA-Z0-9"), ("word", r"\w"), ("space", r"\s"), ("upper", "A-Z"), ("lower", "a-z"), ("punct", r"!-/:-@\[-`{-~")):
        source = source.replace(f"[:{name}:]", members)
    try:
        one = re.compile(source)
    except re.error:
        return Signs.SOME
    hits = sum(one.match(c) is not None for c in _WORD)
    if not hits and re.fullmatch(r"\[(\\.|[^\\^])\]", text, re.S) and not re.fullmatch(r"\[\\[dDwWsSpP]\]", text):
        return Signs.SOME
    return Signs.NONE if not hits else Signs.ALL if hits == len(_WORD) else Signs.SOME


def _for_python(text: str) -> str:
    """The pattern with what Python's dialect lacks replaced, only to see whether the rest is well-formed."""
    plain_groups = re.sub(r"\(\?[a-zA-Z-]+([:)])", lambda m: "(?:" if m[1] == ":" else "", text)
    return re.sub(r"\\[pP](\{[^}]*\}|\w)|\[:\w+:\]|\\x\{[^}]*\}|\\b\{[^}]*\}", "x", plain_groups).replace(r"\z", r"\Z")


def to_java(text: str) -> str:
    """The pattern in the dialect of the JVM: named groups, half boundaries, code points, and end of text."""
    out = re.sub(r"\(\?P<", "(?<", text)
    out = re.sub(r"\[:(\w+):\]", lambda m: {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "space": r"\s", "word": r"\w"}.get(m[1], m[0]), out)
    out = re.sub(r"\\u\{([0-9a-fA-F]+)\}", r"\\x{\1}", out)
    result, i, inside = "", 0, 0
    while i < len(out):
        if out[i] == "\\":
            result += out[i : i + 2]
            i += 2
            continue
        inside += (out[i] == "[") - (out[i] == "]" and inside > 0)
        result += r"\z" if out[i] == "$" and not inside else out[i]
        i += 1
    return result


@dataclass(frozen=True)
class Pattern:
    """A pattern that has been analysed; ``java`` is None where it matches every name."""

    original: str
    java: str | None
    literal: str | None = None

    @staticmethod
    def parse(text: str, case: Case = Case.SENSITIVE, word: bool = False) -> Pattern:
        """ValueError if the pattern is invalid or no name can match it."""
        fold = case is Case.INSENSITIVE or case is Case.SMART and not any(c.isupper() for c in text)
        parser = _Parser(text)
        alternatives = parser.alternatives()
        if parser.at < len(text):
            raise ValueError("invalid regex pattern: unopened group")
        try:
            re.compile(_for_python(text))
        except re.error as e:
            raise ValueError(f"invalid regex pattern: {e}") from None
        hopeful = [a for a in alternatives if not hopeless(a)]
        if not hopeful:
            raise ValueError("pattern cannot match any identifier (impossible character class)")
        if all(map(unconditional, hopeful)) and not word:
            return Pattern(text, None)
        plain = not META & set(text)
        flags = "(?iuUd)" if fold else "(?Ud)"
        body = re.sub(r"([^\w\s])", r"\\\1", text) if plain and word else to_java(text)
        java = f"{flags}(?<!\\w)(?:{body})(?!\\w)" if word else f"{flags}(?:{body})"
        return Pattern(text, java, text if plain and not fold and not word else None)

    def matches(self, column: Column) -> Column:
        """The predicate; a plain text becomes ``contains``, which the Parquet reader can push down."""
        if self.java is None:
            return F.lit(True)
        return column.contains(self.literal) if self.literal is not None else column.rlike(self.java)


def any_matches(patterns: list[Pattern], column: Column) -> Column:
    return F.lit(True) if any(p.java is None for p in patterns) else any_of([p.matches(column) for p in patterns])
