"""Scanning, extraction, kept results, output, command line and the request protocol, end to end on small trees."""

import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from symbolith import __main__ as cli
from symbolith import api, languages, model, store
from symbolith.extract.registry import EXTRACTORS
from symbolith.extract.scanner import normalised
from symbolith.functions import text
from symbolith.operators import relational as ops
from symbolith.pattern import Case, Pattern
from symbolith.sources import globs, scan
from symbolith.streaming.requests import Session, parsed, serve


@pytest.fixture
def tree(tmp_path):
    files = {
        "a/one.py": "class Box:\n    size = 1\n    @property\n    def width(self):\n        return 1\n\ndef free():\n    pass\n",
        "a/two.go": "package main\n\nfunc Run() {}\n",
        "a.py": "TOP = 1\n",
        ".hidden/h.py": "def unseen(): pass\n",
        "skip/gone.py": "def gone(): pass\n",
        "skip/kept.py": "def kept(): pass\n",
        "bad.py": b"\xff\xfe",
        "notes.txt": "def no(): pass",
        "lib/x.lua": "function f() end\n",
        ".gitignore": "skip/*\n!kept.py\n",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return tmp_path


def scopes(result):
    return [(r.path.rsplit("/", 1)[-1], r.kind, r.scope) for r in ops.in_order(result.defs).collect()]


def test_search_prunes_reads_and_reports(spark, tree):
    found = api.search(spark, [r"\w*"], [str(tree)])
    assert scopes(found) == [("one.py", "class", "Box"), ("one.py", "field", "Box.size"), ("one.py", "getter", "Box.width"), ("one.py", "function", "free"), ("two.go", "package", "main"), ("two.go", "function", "Run"), ("a.py", "var", "TOP"), ("x.lua", "function", "f"), ("kept.py", "function", "kept")]
    assert [r.phase for r in found.errors.collect()] == ["read"] and found.status() == 2
    only = lambda **o: {n for n, _, _ in scopes(api.search(spark, [r"\w*"], [str(tree)], options=scan.Options(**o)))}
    assert "h.py" in only(hidden=True) and "gone.py" in only(no_ignore=True)
    assert only(max_depth=1) == {"a.py"} and only(globs=("*.py", "!a/**")) == {"a.py", "kept.py"}
    assert only(languages=("golang",)) == {"two.go"}
    assert scopes(api.search(spark, ["Box"], [str(tree)], kinds=["callable"])) == [("one.py", "getter", "Box.width")]
    assert api.search(spark, ["nothing_here"], [str(tree / "a")]).status() == 1
    assert api.search(spark, ["Run"], [str(tree / "a")]).status() == 0
    assert scopes(api.search(spark, ["free"], [str(tree / "a"), str(tree / "a" / "one.py")])) == [("one.py", "function", "free")] * 2
    for bad in ({"roots": ["/nowhere/at/all"]}, {"kinds": ["nonsense"]}, {"options": scan.Options(languages=("klingon",))}, {"patterns": ["("]}):
        with pytest.raises(ValueError):
            api.search(spark, **{"patterns": ["x"], "roots": [str(tree)], **bad})


def test_kept_results_equal_fresh_ones(spark, tree):
    options = scan.Options(project_root=str(tree))
    rows = lambda keep: sorted(map(tuple, api.search(spark, [r"\w*"], [], options=options, keep=keep).defs.collect()))
    fresh = rows(False)
    assert rows(True) == fresh and rows(True) == fresh
    assert store.load(spark, str(tree)).filter("path like '%one.py'").count() == 1
    (tree / "a" / "one.py").write_text("def changed_now(): pass\n")
    (tree / "a.py").unlink()
    assert "changed_now" in {r[6] for r in rows(True)} and not {"free", "TOP"} & {r[6] for r in rows(True)}
    assert store.load(spark, str(tree)).filter("path like '%/a.py'").count() == 1
    store.vacuum(spark, str(tree), scan.scan(spark, [], options))
    assert store.load(spark, str(tree)).filter("path like '%/a.py'").count() == 0


def test_command_line(spark, tree):
    def run(*argv):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(argv), spark, out, err), out.getvalue().splitlines(), err.getvalue()

    base = str(tree / "a")
    assert run("def", "free", base) == (0, [f"{base}/one.py:7-8 [function/free] def free()"], "")
    assert run("def", "-e", "FREE", "-i", "-I", "--no-signature", base)[1] == ["7-8 [function/free]"]
    assert run("def", "-c", "Box", base)[1] == [f"{base}/one.py:3"] and run("def", "-l", "Box", base)[1] == [f"{base}/one.py"]
    assert run("def", "zzz", base)[0] == 1 and run("def", base + "(")[0] == 2 and run("def", "x", "/nowhere")[0] == 2
    code, lines, _ = run("outline", "--heading", base)
    assert code == 0 and lines[0] == f"{base}/one.py" and "3-5 @property def width(self)" in lines and lines[lines.index("") + 1] == f"{base}/two.go"
    events = [json.loads(x) for x in run("def", "--json", "Run", base)[1]]
    assert [e["type"] for e in events] == ["begin", "match", "end", "summary"] and events[3]["data"] == {"matched": 1, "files": 1, "errors": 0}
    with pytest.raises(SystemExit):
        run("def", "-i", "-S", "x")


def test_requests(spark, tree):
    s = Session(spark)
    ask = lambda method, **params: json.loads(s.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
    tool = lambda name, **args: ask("tools/call", name=name, arguments=args)
    assert ask("tools/list")["error"]["code"] == -32600 and json.loads(s.answer("{"))["error"]["code"] == -32700
    assert json.loads(s.answer("[]"))["error"]["code"] == -32600 and ask("nope")["error"]["code"] == -32601
    assert "serverInfo" in ask("initialize")["result"] and ask("initialize")["error"]["code"] == -32600
    assert s.answer('{"jsonrpc": "2.0", "method": "notifications/initialized"}') is None and ask("ping")["result"] == {}
    assert len(ask("tools/list")["result"]["tools"]) == 3
    assert tool("outline", path="a")["result"]["isError"] and tool("set_project_root", root="rel")["error"]["code"] == -32602
    tool("set_project_root", root=str(tree))
    assert tool("search_definitions", pattern="free", path="a")["result"]["content"][0]["text"] == "a/one.py:7-8 [function/free] def free()"
    assert "--- errors ---\nbad.py: " in tool("search_definitions", pattern="nothing")["result"]["content"][0]["text"]
    assert tool("search_definitions", pattern="Box", path="a", head_limit=2)["result"]["content"][0]["text"] == "No definitions found."
    for bad in ({"pattern": "["}, {"pattern": "x", "kind": "zzz"}, {"pattern": "x", "language": "zzz"}, {}):
        assert tool("search_definitions", **bad)["error"]["code"] == -32602


def test_request_frames_and_stream(spark, tmp_path):
    lines = ['{"jsonrpc":"2.0","id":1,"method":"ping"}', "{", '{"id":1,"method":"ping"}', '{"jsonrpc":"2.0","method":"x"}']
    got = parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.code for r in got] == [None, -32700, -32600, -32601]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:2]) + "\n")
    out = []
    query = serve(Session(spark), spark.readStream.text(str(tmp_path / "in")), out.append)
    query.processAllAvailable()
    query.stop()
    assert [json.loads(x).get("error", {}).get("code") for x in out] == [None, -32700]


@pytest.mark.parametrize(
    "pattern, verdict",
    [(r"\w*", None), (".*", None), (".+", None), ("^.*$", None), ("(.*)", None), (r"\w+|.*", None), ("a.*", "x"), ("foo", "x"), (r"\bfoo\b", "x"), ("[a-z]*", "x"), (r"\W+", ValueError), ("a-b", "x"), (r"a[-:]b", ValueError), (r"[.]", "x"), (r"[.:]", ValueError), (r"[.:]+x|\s", ValueError), (r"[.:]?a", "x"), (r"(?:\s|-)x", "x"), (r"\s|foo", "x"), (r"(.*)|\W", None), (r"(?:\b)+", ValueError), (".{20}", None), ("^$", None), ("(?=a)", ValueError), (r"(a)\1", ValueError), ("a++", ValueError), ("a(", ValueError), ("[a", ValueError), ("*a", ValueError), (r"(?:\b)", "x"), (r"(\b)a", ValueError), (r"\p{Lu}\w*", "x"), ("(?i)foo", "x"), ("(?P<n>a)", "x")],
)
def test_pattern_analysis(pattern, verdict):
    if verdict is ValueError:
        with pytest.raises(ValueError):
            Pattern.parse(pattern)
    else:
        assert (Pattern.parse(pattern).java is None) == (verdict is None)


def test_pattern_matching(spark):
    names = ["Foo.bar", "foo", "my.$Name", "Éa", "foo\n", "barfoo", "a.b"]
    df = spark.createDataFrame([(n,) for n in names], "scope string")
    hit = lambda *a, **k: [r.scope for r in df.filter(Pattern.parse(*a, **k).matches(F.col("scope"))).collect()]
    assert hit("foo") == ["foo", "foo\n", "barfoo"] and hit("foo", Case.SMART) == ["Foo.bar", "foo", "foo\n", "barfoo"] and hit("Foo", Case.SMART) == ["Foo.bar"]
    assert hit("foo", word=True) == ["foo", "foo\n"] and hit(r"\$Name", word=True) == ["my.$Name"] and hit("éA", Case.INSENSITIVE) == ["Éa"]
    assert hit("foo$") == ["foo", "barfoo"] and hit("a.b", word=True) == ["a.b"] and hit(r"^\w+$") == ["foo", "Éa", "barfoo"]


def test_text_expressions_against_python(spark):
    rng = random.Random(1)
    strings = ["".join(rng.choice(["a", "é", "中", "😀", "(", ")", " ", "\t", ".", ":", "\\"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for limit in (4, 5, 6, 7):
        got = df.select("s", text.cut_bytes(F.col("s"), limit).alias("c")).collect()
        assert all(r.c == r.s.encode()[:limit].decode("utf-8", "ignore") for r in got)
    got = df.select("s", text.scope_depth(F.col("s")).alias("d"), text.normalised(F.col("s")).alias("n")).collect()
    assert all(r.d == 1 + len(re.findall(r"::|[.\\]", r.s)) and r.n == normalised(r.s) for r in got)


def test_globs():
    fits = lambda g, p: bool(re.search(globs.to_regex(g), p))
    assert fits("*.py", "a/b.py") and not fits("/*.py", "a/b.py") and fits("a/**/b.py", "a/b.py") and fits("a/**/b.py", "a/x/y/b.py")
    assert fits("*.{py,go}", "x.go") and fits("[!a]b", "cb") and not fits("[!a]b", "ab") and fits("dir/", "dir/x") and not fits("a?c", "a/c")
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            globs.to_regex(bad)


def test_kinds_and_languages():
    assert len(model.KINDS) == 54 and len(languages.LANGUAGES) == 18 and sorted(map(len, model.CATEGORIES.values())) == [4, 7, 9, 12, 16]
    assert model.kinds_of("function") == ["function", "function_declaration"] and model.kinds_of("function_definition") == ["function"] and model.kinds_of("alias") == ["alias"] and model.kinds_of("x") == []
    assert languages.route("h") == "cplusplus" and languages.route("h", ["obj-c"]) == "objc" and languages.route("h", ["obj-c", "c++"]) == "cplusplus" and languages.route("lua", ["Luau"]) == "luau" and languages.route("zig") is None
    assert set(EXTRACTORS) == set(languages.BY_NAME) and all(k in model.KINDS for x in languages.LANGUAGES for k in x.kinds)


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_extractors_survive_noise(language):
    rng = random.Random(language)
    tokens = ["class", "def", "fn", "func", "function", "end", "{", "}", "(", ")", "[", "]", "\n", " ", ";", "=", ":", "::", "x", "Y", "'", '"', "/*", "*/", "//", "#", "@", "enum", "struct", "<", ">", ",", "->", "=>", "local", "if", "\\"]
    for _ in range(150):
        source = " ".join(rng.choice(tokens) for _ in range(rng.randint(0, 60)))
        for d in EXTRACTORS[language](source):
            assert d.kind in model.KINDS and 1 <= d.line_start <= max(d.line_start, d.line_end)


@pytest.mark.parametrize("language", ["javascript", "typescript"])
def test_signs_in_pattern_literals_are_no_brackets_or_quotes(language):
    text = "const re = /[{}\"'/]/g;\nfunction split(a) { return a / 2 / 3; }\nclass Box { run() { return x.replace(/\\/\\{/, \"\"); } }\nconst half = n / 2;\nfunction last() {}\n"
    found = [(d.kind, d.scope, d.line_start, d.line_end) for d in EXTRACTORS[language](text)]
    for wanted in (("function", "split", 2, 2), ("class", "Box", 3, 3), ("function", "last", 5, 5)):
        assert wanted in found, found
    assert any(scope == "half" and a == b == 4 for _, scope, a, b in found)


def test_here_documents_hold_no_definitions():
    text = "one() {\n  cat <<-'EOF'\n\tfake() {\n\tEOF\n}\ntwo() {\n  cat <<X | sort\nother() { {\nX\n  grep x <<< \"$a\"\n}\n"
    found = [(d.kind, d.scope, d.line_start, d.line_end) for d in EXTRACTORS["bash"](text)]
    assert found == [("function", "one", 1, 5), ("function", "two", 6, 11)]


def test_options_may_stand_anywhere():
    define = next(a.choices for a in cli.arguments()._actions if a.dest == "command")["def"]
    order = lambda text: cli.in_order(define, text.split())
    assert order("foo -i src") == ["-i", "--", "foo", "src"]
    assert order("-w -foo") == ["-w", "--", "-foo"]
    assert order("-e -x src") == ["-e-x", "--", "src"]
    assert order("foo src -k function --max-depth 3") == ["-kfunction", "--max-depth=3", "--", "foo", "src"]
    assert order("-wik function foo") == ["-w", "-i", "-kfunction", "--", "foo"]
    assert order("-kfunction -- -i x") == ["-kfunction", "--", "-i", "x"]
    assert order("foo --glob=*.py -") == ["--glob=*.py", "--", "foo", "-"]


def test_command_line_reorders_and_hides_a_single_file(spark, tree):
    def run(*argv):
        out, err = io.StringIO(), io.StringIO()
        return cli.main(list(argv), spark, out, err), out.getvalue().splitlines()

    one = str(tree / "a" / "one.py")
    status, hidden = run("def", "FREE", one, "-i")
    _, shown = run("def", "free", one, "-H")
    assert status == 0 and len(hidden) == len(shown) == 1 and "one.py" not in hidden[0]
    assert shown[0].endswith(f"one.py:{hidden[0]}") and hidden[0].startswith("7-8")
    assert "one.py" in run("def", "free", str(tree / "a"))[1][0]
    assert run("def", one, "-e", "-x")[0] == 1
