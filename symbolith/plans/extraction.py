"""Queries that extract definitions from generated sources, one language each; SQL builds the rows to expect.

Every row of ``part`` gives one source; ``{n}`` stands for its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import definitions_of

#: Language: source, and its definitions as (kind, first line, last line, scope, signature).
CASES = {
    "python": ("class Box{n}(Base):\n    size = {n}\n    def grow(self):\n        pass\n", [("class", 1, 4, "Box{n}", "class Box{n}(Base)"), ("field", 2, 2, "Box{n}.size", "size"), ("method", 3, 4, "Box{n}.grow", "def grow(self)")]),
    "go": ("package main\n\nfunc (b *Box{n}) Grow(by int) int {\n\treturn by\n}\n", [("package", 1, 1, "main", "package main"), ("method", 3, 5, "Box{n}.Grow", "func (b *Box{n}) Grow(by int) int")]),
    "rust": ("pub struct Box{n} {\n    size: u32,\n}\nfn grow{n}(x: u32) -> u32 { x }\n", [("struct", 1, 3, "Box{n}", "pub struct Box{n}"), ("field", 2, 2, "Box{n}::size", "size: u32"), ("function", 4, 4, "grow{n}", "fn grow{n}(x: u32) -> u32")]),
    "javascript": ("class Box{n} {\n  grow(by) { return by; }\n}\n", [("class", 1, 3, "Box{n}", "class Box{n}"), ("method", 2, 2, "Box{n}.grow", "grow(by)")]),
    "typescript": ("export interface Box{n} {\n  size: number;\n}\n", [("interface", 1, 3, "Box{n}", "export interface Box{n}"), ("property_declaration", 2, 2, "Box{n}.size", "size: number")]),
    "java": ("public class Box{n} {\n    static final int SIZE = {n};\n    int grow(int by) { return by; }\n}\n", [("class", 1, 4, "Box{n}", "public class Box{n}"), ("const", 2, 2, "Box{n}.SIZE", "static final int SIZE = {n};"), ("method", 3, 3, "Box{n}.grow", "int grow(int by)")]),
    "csharp": ("namespace Shop{n} {\n    struct Box {\n        double Size;\n    }\n}\n", [("namespace", 1, 5, "Shop{n}", "namespace Shop{n}"), ("struct", 2, 4, "Shop{n}.Box", "struct Box"), ("field", 3, 3, "Shop{n}.Box.Size", "double Size")]),
    "php": ("<?php\nclass Box{n} {\n    public function grow($by) { return $by; }\n}\n", [("class", 2, 4, "Box{n}", "class Box{n}"), ("method", 3, 3, "Box{n}::grow", "public function grow($by)")]),
    "c": ("#define SIZE{n} 3\nint grow{n}(int by) {\n    return by;\n}\n", [("macro", 1, 1, "SIZE{n}", "#define SIZE{n} 3"), ("function", 2, 4, "grow{n}", "int grow{n}(int by)")]),
    "cplusplus": ("namespace shop{n} {\nint grow(int by) { return by; }\n}\n", [("namespace", 1, 3, "shop{n}", "namespace shop{n}"), ("function", 2, 2, "shop{n}::grow", "int grow(int by)")]),
    "kotlin": ("package shop\n\nfun grow{n}(by: Int): Int {\n    return by\n}\n", [("package", 1, 1, "shop", "package shop"), ("function", 3, 5, "grow{n}", "fun grow{n}(by: Int): Int")]),
    "swift": ("struct Box{n} {\n    var size: Int\n    func grow(by: Int) -> Int { by }\n}\n", [("struct", 1, 4, "Box{n}", "struct Box{n}"), ("property", 2, 2, "Box{n}.size", "var size: Int"), ("method", 3, 3, "Box{n}.grow", "func grow(by: Int) -> Int")]),
    "ruby": ("module Shop{n}\n  def grow(by)\n    by\n  end\nend\n", [("module", 1, 5, "Shop{n}", "module Shop{n}"), ("method", 2, 4, "Shop{n}::grow", "def grow(by)")]),
    "dart": ("class Box{n} {\n  int grow(int by) => by;\n}\n", [("class", 1, 3, "Box{n}", "class Box{n}"), ("method", 2, 2, "Box{n}.grow", "int grow(int by)")]),
    "bash": ("readonly SIZE{n}=3\ngrow{n}() {\n  echo 1\n}\n", [("const", 1, 1, "SIZE{n}", "readonly SIZE{n}"), ("function", 2, 4, "grow{n}", "grow{n}()")]),
    "lua": ("function Box{n}:grow(by)\n  return by\nend\n", [("method", 1, 3, "Box{n}.grow", "function Box{n}:grow(by)")]),
    "luau": ("type Size{n} = number\nfunction grow{n}(by)\n  return by\nend\n", [("alias", 1, 1, "Size{n}", "type Size{n} = number"), ("function", 2, 4, "grow{n}", "function grow{n}(by)")]),
    "objc": ("@class Box{n};\nint grow{n}(int by) {\n    return by;\n}\n", [("class_declaration", 1, 1, "Box{n}", "@class Box{n};"), ("function", 2, 4, "grow{n}", "int grow{n}(int by)")]),
}


def _query(language: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("p_partkey").cast("string")
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        source = F.replace(F.lit(CASES[language][0]), F.lit("{n}"), key)
        rows = part.select(F.concat(F.lit("f"), key).alias("path"), F.lit(language).alias("language"), source.alias("source"))
        return definitions_of(rows)

    return run


def _expected(language: str) -> str:
    text = lambda s: f"replace('{s}', '{{n}}', CAST(p_partkey AS VARCHAR))"
    rows = [f"SELECT {text('f{n}')} AS path, CAST({k} AS INTEGER) AS ordinal, '{language}' AS language, '{kind}' AS kind, CAST({a} AS INTEGER) AS line_start, CAST({b} AS INTEGER) AS line_end, {text(scope)} AS scope, {text(signature)} AS signature FROM part" for k, (kind, a, b, scope, signature) in enumerate(CASES[language][1])]
    return " UNION ALL ".join(rows)


QUERIES = {f"extract_{x}": _query(x) for x in CASES}
SQL = {f"extract_{x}": _expected(x) for x in CASES}


def page_script_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of the scripts that pages hold."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    script = F.regexp_extract("html", r"<script>(.*?)</script>", 1)
    rows = pages.select(F.col("page_id").cast("string").alias("path"), F.lit("javascript").alias("language"), script.alias("source"))
    return definitions_of(rows).select("path", "kind", "scope")


QUERIES["page_script_vars"] = page_script_vars
SQL["page_script_vars"] = "SELECT CAST(page_id AS VARCHAR) AS path, 'var' AS kind, regexp_extract(html, '<script>.*?var (\\w+)', 1) AS scope FROM pages WHERE regexp_matches(html, '<script>[^<]*?var \\w+')"
