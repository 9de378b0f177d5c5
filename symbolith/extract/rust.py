"""Rust: items with their attributes, members of types, traits and impls."""

from __future__ import annotations

import re

from .scanner import Source, Syntax, join

SYNTAX = Syntax(nested=True, strings=(('r#"', '"#', False), ('"', '"', True), ("'", "'", True), ("lifetime", "lifetime", False)))
#: Traits whose methods have a kind of their own (fixed values).
OPERATORS = set("Add Sub Mul Div Rem Neg Not BitAnd BitOr BitXor Shl Shr AddAssign SubAssign MulAssign DivAssign RemAssign BitAndAssign BitOrAssign BitXorAssign ShlAssign ShrAssign PartialEq Eq PartialOrd Ord Fn FnMut FnOnce Deref DerefMut".split())
ITEM = re.compile(r"((?:pub(?:\s*\([^)]*\))?|default|const(?=\s+(?:unsafe|async|extern|fn))|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*(?:(fn|struct|union|enum|trait|type|const|static|mod|impl|use)\b|(macro_rules!))\s*(mut\s+)?(\w+)?")


def extract(text: str) -> list:
    src = Source(text, SYNTAX)
    _items(src, 0, len(text), "", None)
    return src.out


def _items(src: Source, a: int, b: int, scope: str, owner: str | None) -> None:
    """``owner``: None at the level of modules, else the name of the trait ('' for a plain impl) whose members these are."""
    for s in src.statements(a, b):
        begin = at = s.begin
        while src.code.startswith("#", at):
            bracket = src.code.find("[", at, b)
            at = src.match(bracket, b) + 1 if bracket >= 0 else b
            at += len(src.code[at:b]) - len(src.code[at:b].lstrip())
        head = src.code[at : s.head]
        m = ITEM.match(head)
        if not m or m[2] == "use":
            continue
        word, name = m[2] or m[3], m[5] or ""
        body = s.open >= 0
        signature = src.flat(begin, s.head if body else s.end)
        own = join(scope, name, "::")
        if word == "fn":
            if owner is None:
                kind = "macro" if "proc_macro" in src.code[begin:at] else "function"
            else:
                kind = "operator" if owner in OPERATORS else "subscript" if owner in ("Index", "IndexMut") else "destructor" if owner == "Drop" else "method"
            src.add(kind if body else f"{kind}_declaration", own, signature, begin, s.end)
        elif word in ("struct", "union", "enum"):
            src.add(word, own, signature, begin, s.end)
            if body:
                _members(src, s.open + 1, s.close, own, word)
        elif word == "trait":
            src.add("trait", own, signature, begin, s.end)
            if body:
                _items(src, s.open + 1, s.close, own, name)
        elif word == "impl":
            inner = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", head[m.end(2) :])
            inner = re.split(r"\bwhere\b", inner)[0].strip()
            trait, _, target = inner.rpartition(" for ")
            of = lambda t: re.sub(r"<.*", "", re.sub(r"^[&*]\s*(?:'\w+\s+)?(?:mut\s+)?", "", t.strip()), flags=re.S).strip()
            flat = f"{of(trait).split('::')[-1]} for {of(target)}" if trait else of(inner)
            src.add("impl", join(scope, flat, "::"), signature, begin, s.end)
            if body:
                _items(src, s.open + 1, s.close, join(scope, of(target or inner), "::"), of(trait).split("::")[-1] if trait else "")
        elif word == "mod":
            src.add("module" if body else "module_declaration", own, signature, begin, s.end)
            if body:
                _items(src, s.open + 1, s.close, own, None)
        elif word == "macro_rules!":
            src.add("macro", own, src.flat(begin, s.close if body else s.end), begin, s.end)
        elif word == "type":
            src.add("alias" if owner is None else "associated_type", own, signature, begin, s.end)
        elif name != "_":
            src.add("var" if m[4] else "const", own, src.flat(begin, s.end), begin, s.end)


def _members(src: Source, a: int, b: int, scope: str, word: str) -> None:
    for x, y in src.parts(a, b):
        at = x
        while src.code.startswith("#", at):
            bracket = src.code.find("[", at, y)
            at = src.match(bracket, y) + 1 if bracket >= 0 else y
            at += len(src.code[at:y]) - len(src.code[at:y].lstrip())
        code = src.code[at:y]
        if word == "enum":
            if m := re.match(r"\w+", code):
                own, brace = join(scope, m[0], "::"), at + m.end() + len(code[m.end() :]) - len(code[m.end() :].lstrip())
                record = brace < y and src.code[brace] == "{"
                src.add("variant", own, src.flat(x, brace if record else y), x, y)
                if record:
                    _members(src, brace + 1, src.match(brace, y), own, "struct")
        elif m := re.match(r"(?:pub(?:\s*\([^)]*\))?\s+)?(\w+)\s*:", code):
            src.add("field", join(scope, m[1], "::"), src.flat(x, y), x, y)
