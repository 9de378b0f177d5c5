"""Command line: ``python -m symbolith def PATTERN [PATH...]`` and ``python -m symbolith outline [PATH...]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import api
from .operators import relational as ops
from .pattern import Case
from .sources.scan import Options, is_file, resolved


def arguments() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("-k", "--kind", action="append", default=[], help="kind or category; repeat or separate by commas")
    shared.add_argument("--language", action="append", default=[])
    shared.add_argument("-g", "--glob", action="append", default=[])
    shared.add_argument("--hidden", action="store_true")
    shared.add_argument("--no-ignore", action="store_true")
    shared.add_argument("-d", "--max-depth", type=int)
    shared.add_argument("-D", "--max-scope-depth", type=int)
    shared.add_argument("--project-root")
    shared.add_argument("--json", action="store_true")
    shared.add_argument("--no-signature", action="store_true")
    shared.add_argument("-M", "--no-messages", action="store_true")
    names = shared.add_mutually_exclusive_group()
    names.add_argument("-H", "--with-filename", action="store_true")
    names.add_argument("-I", "--no-filename", action="store_true")
    heads = shared.add_mutually_exclusive_group()
    heads.add_argument("--heading", action="store_true")
    heads.add_argument("--no-heading", action="store_true")
    top = argparse.ArgumentParser(prog="symbolith")
    commands = top.add_subparsers(dest="command", required=True)
    define = commands.add_parser("def", parents=[shared], help="definitions whose names match")
    define.add_argument("-e", "--regexp", action="append", default=[])
    cases = define.add_mutually_exclusive_group()
    cases.add_argument("-i", "--ignore-case", action="store_true")
    cases.add_argument("-S", "--smart-case", action="store_true")
    define.add_argument("-w", "--word-regexp", action="store_true")
    shapes = define.add_mutually_exclusive_group()
    shapes.add_argument("-l", "--files-with-matches", action="store_true")
    shapes.add_argument("-c", "--count", action="store_true")
    define.add_argument("rest", nargs="*", metavar="PATTERN PATH")
    commands.add_parser("outline", parents=[shared], help="all definitions of files").add_argument("rest", nargs="*", metavar="PATH")
    return top


def in_order(parser: argparse.ArgumentParser, argv: list[str]) -> list[str]:
    """The arguments of a command with its options first, wherever they stood; a value that begins with a dash is tied to
    its option, and what looks like an option but is none of the command's is a name or path."""
    takes_value = {name: action.nargs != 0 for action in parser._actions for name in action.option_strings}

    def options(word: str) -> list[str] | None:
        """The options that a word stands for, short ones one by one; None if it is no option."""
        if word.startswith("--"):
            return [word] if word.partition("=")[0] in takes_value else None
        letters = [f"-{c}" for c in word[1:]] if word.startswith("-") else []
        for k, letter in enumerate(letters):
            if letter not in takes_value:
                return None
            if takes_value[letter] and k < len(letters) - 1:
                return [*letters[:k], letter + word[k + 2 :]]
        return letters or None

    found, names, rest = [], [], list(argv)
    while rest:
        word = rest.pop(0)
        if word == "--":
            names += rest
            break
        own = options(word)
        if own is None:
            names.append(word)
        elif takes_value.get(own[-1]) and rest and rest[0] != "--" and options(rest[0]) is None:
            value = rest.pop(0)
            found += [*own[:-1], f"{own[-1]}={value}" if own[-1].startswith("--") else own[-1] + value]
        else:
            found += own
    return [*found, "--", *names]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    argv = sys.argv[1:] if argv is None else argv
    parser = arguments()
    commands = next(a.choices for a in parser._actions if isinstance(a, argparse._SubParsersAction))
    if argv and argv[0] in commands:
        argv = [argv[0], *in_order(commands[argv[0]], argv[1:])]
    args = parser.parse_args(argv)
    define = args.command == "def"
    patterns, paths = (args.regexp, args.rest) if define and args.regexp else (args.rest[:1], args.rest[1:]) if define else ([], args.rest)
    if define and not patterns:
        print("error: a pattern is required", file=err)
        return 2
    spark = spark or SparkSession.builder.appName("symbolith").getOrCreate()
    tags = [t for k in args.kind for t in k.split(",") if t]
    options = Options(hidden=args.hidden, no_ignore=args.no_ignore, max_depth=args.max_depth, globs=tuple(args.glob), languages=tuple(args.language), project_root=args.project_root)
    common = {"kinds": tags, "max_scope_depth": args.max_scope_depth, "options": options, "keep": bool(args.project_root)}
    try:
        if define:
            case = Case.INSENSITIVE if args.ignore_case else Case.SMART if args.smart_case else Case.SENSITIVE
            found = api.search(spark, patterns, paths, case=case, word=args.word_regexp, **common)
        else:
            found = api.outline(spark, paths, **common)
    except ValueError as e:
        print(f"error: {e}", file=err)
        return 2
    one_file = len(paths) == 1 and is_file(spark, resolved(paths, args.project_root)[0])
    filename = args.with_filename or not (args.no_filename or one_file)
    shape = "files" if define and args.files_with_matches else "count" if define and args.count else "lines"
    if args.json:
        lines = (r["json"] for r in ops.ndjson_in_order(ops.ndjson(found.defs, found.errors, matches=shape == "lines")).toLocalIterator())
    elif shape == "files":
        lines = (r["path"] for r in ops.files(found.defs).orderBy(ops.text.path_order(ops.F.col("path"))).toLocalIterator())
    elif shape == "count":
        lines = (f"{r['path']}:{r['n']}" if filename else str(r["n"]) for r in ops.counts(found.defs).orderBy(ops.text.path_order(ops.F.col("path"))).toLocalIterator())
    else:
        lines = api.text_lines(found, signature=not args.no_signature, filename=filename, heading=args.heading, survey=not define)
    for line in lines:
        print(line, file=out)
    if not args.no_messages:
        for r in found.errors.toLocalIterator():
            print(f"error: {r['path']}: {r['message']}", file=err)
    return found.status()


if __name__ == "__main__":
    sys.exit(main())
