"""Languages, their file extensions, aliases and kinds; and which language a file is in."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    aliases: tuple[str, ...]
    separator: str
    kinds: frozenset[str]


def _language(name: str, extensions: str, aliases: str, separator: str, kinds: str) -> Language:
    return Language(name, tuple(extensions.split()), tuple(aliases.split()), separator, frozenset(kinds.split()))


#: In the order that decides who owns a shared extension (fixed values).
LANGUAGES = [
    _language("python", "py pyw pyi gyp gypi wsgi", "py python3", ".", "function class enum protocol alias var field variant method constructor destructor getter setter operator subscript"),
    _language("go", "go", "golang", ".", "function method struct interface alias field const var package method_declaration"),
    _language("rust", "rs", "rs", "::", "function function_declaration struct union enum alias associated_type trait const var macro module module_declaration method method_declaration operator operator_declaration subscript subscript_declaration destructor destructor_declaration impl variant field"),
    _language("javascript", "js jsx mjs cjs", "js node ecmascript", ".", "function class method constructor getter setter field const var"),
    _language("typescript", "ts tsx mts cts", "ts", ".", "function class method constructor getter setter field const var interface alias enum variant namespace function_declaration method_declaration constructor_declaration getter_declaration setter_declaration property_declaration subscript_declaration module_declaration class_declaration enum_declaration const_declaration var_declaration"),
    _language("java", "java", "", ".", "package class interface record enum variant annotation method method_declaration constructor field const module"),
    _language("csharp", "cs csx cake linq", "cs c# c-sharp", ".", "namespace class interface struct enum record method method_declaration constructor destructor delegate event const field variant subscript property getter setter operator operator_declaration"),
    _language("php", "php phtml phar ctp", "", "\\", "namespace class interface trait enum function method method_declaration constructor destructor getter setter operator property const variant"),
    _language("c", "c", "", "::", "function function_declaration struct struct_declaration union union_declaration enum enum_declaration alias const const_declaration var var_declaration field variant macro"),
    _language("cplusplus", "cpp cxx cc hpp hxx hh h ixx cppm inl tcc tpp ipp inc ino txx", "cpp c++ cxx", "::", "namespace linkage class class_declaration struct struct_declaration union union_declaration enum enum_declaration function function_declaration method method_declaration constructor constructor_declaration destructor destructor_declaration operator operator_declaration alias const const_declaration var var_declaration field variant macro concept"),
    _language("kotlin", "kt kts", "kt", ".", "package class interface enum annotation object function function_declaration method method_declaration operator operator_declaration const var property getter setter constructor variant alias"),
    _language("swift", "swift swiftinterface", "", ".", "class struct enum actor extension protocol function method method_declaration operator operator_declaration constructor constructor_declaration destructor subscript subscript_declaration variant associated_type alias const var property property_declaration macro"),
    _language("ruby", "rb rake gemspec ru rbi podspec jbuilder thor rabl builder god", "rb", "::", "module class method operator constructor struct const var alias property getter setter"),
    _language("dart", "dart", "", ".", "module class mixin interface enum variant extension extension_type alias function method method_declaration operator constructor getter setter const var field"),
    _language("bash", "sh bash bats", "shell sh", "::", "function const var"),
    _language("lua", "lua nse rockspec", "", ".", "function method operator getter setter destructor const var field"),
    _language("luau", "luau lua", "", ".", "function method operator getter setter destructor const var field alias"),
    _language("objc", "m h", "objective-c obj-c", ".", "class class_declaration extension protocol method method_declaration property field function function_declaration struct struct_declaration union union_declaration enum enum_declaration alias const const_declaration var var_declaration variant macro"),
]
BY_NAME = {x.name: x for x in LANGUAGES}
_ALIASES = {a: x.name for x in LANGUAGES for a in (*x.aliases, x.name)}
#: Languages of an extension: its owner first, then those that a hint can choose.
BY_EXTENSION: dict[str, list[str]] = {}
for _x in LANGUAGES:
    for _e in _x.extensions:
        BY_EXTENSION.setdefault(_e, []).append(_x.name)


def find(name: str) -> str | None:
    """Canonical name of a language given by name or alias, in any case."""
    return _ALIASES.get(name.lower())


def validated(names: list[str]) -> list[str]:
    """Canonical names; ValueError lists the valid ones."""
    if unknown := [n for n in names if find(n) is None]:
        raise ValueError(f"unknown language: {', '.join(unknown)}; valid: {', '.join(BY_NAME)}")
    return [find(n) for n in names]


def extensions_for(kinds: list[str] | None = None, names: list[str] | None = None) -> list[str]:
    """Extensions of the languages that have one of the kinds and are among the names; unknown names are skipped."""
    chosen = None if names is None else {find(n) for n in names}
    fits = [x for x in LANGUAGES if (kinds is None or x.kinds & set(kinds)) and (chosen is None or x.name in chosen)]
    return sorted({e for x in fits for e in x.extensions})


def route(extension: str, hints: list[str] = ()) -> str | None:
    """Language of a file: the extension's owner, unless the hints name another of its languages and not the owner."""
    languages = BY_EXTENSION.get(extension, [])
    hinted = {find(h) for h in hints}
    if not languages or languages[0] in hinted:
        return languages[0] if languages else None
    return next((x for x in languages[1:] if x in hinted), languages[0])


def routed(extension: Column, hints: list[str] = ()) -> Column:
    """``route`` as an expression: a lookup in a literal map of all extensions."""
    pairs = [(e, route(e, hints)) for e in sorted(BY_EXTENSION)]
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])[extension]


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
