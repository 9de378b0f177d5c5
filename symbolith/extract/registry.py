"""The extractor of each language."""

from . import bash, c_family, classes, ecmascript, go, lua, python, ruby, rust

EXTRACTORS = {
    "python": python.extract,
    "go": go.extract,
    "rust": rust.extract,
    "javascript": ecmascript.javascript,
    "typescript": ecmascript.typescript,
    "java": classes.reader(classes.Java),
    "csharp": classes.reader(classes.CSharp),
    "php": classes.reader(classes.Php),
    "c": c_family.c,
    "cplusplus": c_family.cplusplus,
    "kotlin": classes.reader(classes.Kotlin),
    "swift": classes.reader(classes.Swift),
    "ruby": ruby.extract,
    "dart": classes.reader(classes.Dart),
    "bash": bash.extract,
    "lua": lua.lua,
    "luau": lua.luau,
    "objc": c_family.objc,
}
