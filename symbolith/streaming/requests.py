"""The request and response protocol: JSON lines in, JSON lines out, from any source or as a stream."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, languages, model
from ..operators import relational as ops
from ..pattern import Case
from ..sources.scan import Options

#: Error codes of the protocol (fixed values).
PARSE, INVALID, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
VERSION = "2024-11-05"
TOOLS = {
    "set_project_root": {"root": "string"},
    "search_definitions": {"pattern": "string", "path": "string", "kind": "string", "glob": "string", "language": "string", "case_insensitive": "boolean", "word_match": "boolean", "head_limit": "integer"},
    "outline": {"path": "string", "kind": "string", "language": "string"},
}
REQUIRED = {"set_project_root": ["root"], "search_definitions": ["pattern"], "outline": ["path"]}


class Failure(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Session:
    """State across requests: the project's root and whether the client has introduced itself."""

    spark: SparkSession
    root: str | None = None
    initialised: bool = False

    def answer(self, line: str) -> str | None:
        """The response to one line, None for a notification."""
        ident = None
        try:
            try:
                request = json.loads(line)
            except ValueError as e:
                raise Failure(PARSE, f"parse error: {e}") from None
            if not isinstance(request, dict) or request.get("jsonrpc") != "2.0" or not isinstance(request.get("method"), str):
                raise Failure(INVALID, "invalid request")
            ident, method = request.get("id"), request["method"]
            if method == "notifications/initialized":
                return None
            result = self.result(method, request.get("params") or {})
        except Failure as e:
            return json.dumps({"jsonrpc": "2.0", "id": ident, "error": {"code": e.code, "message": str(e)}})
        return json.dumps({"jsonrpc": "2.0", "id": ident, "result": result})

    def result(self, method: str, params: dict) -> dict:
        if method == "ping":
            return {}
        if method == "initialize":
            if self.initialised:
                raise Failure(INVALID, "already initialized")
            self.initialised = True
            return {"protocolVersion": VERSION, "capabilities": {"tools": {}}, "serverInfo": {"name": "symbolith", "version": "1"}}
        if method not in ("tools/list", "tools/call"):
            raise Failure(METHOD, f"method not found: {method}")
        if not self.initialised:
            raise Failure(INVALID, "not initialized")
        if method == "tools/list":
            return {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in p.items()}, "required": REQUIRED[n]}} for n, p in TOOLS.items()]}
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            raise Failure(PARAMS, f"unknown tool: {name}")
        for k in REQUIRED[name]:
            if not isinstance(given.get(k), str):
                raise Failure(PARAMS, f"missing parameter: {k}")
        return self.call(name, given)

    def call(self, name: str, given: dict) -> dict:
        if name == "set_project_root":
            if not given["root"].startswith("/") and "://" not in given["root"]:
                raise Failure(PARAMS, "root must be an absolute path")
            self.root = given["root"]
            return _text(f"Project root set to {self.root}")
        if self.root is None:
            return _text("Project root is not set.", failed=True)
        kinds = [given["kind"]] if given.get("kind") else []
        if kinds and not model.kinds_of(kinds[0]):
            raise Failure(PARAMS, f"unknown kind: {kinds[0]}")
        names = [given["language"]] if given.get("language") else []
        if names and languages.find(names[0]) is None:
            raise Failure(PARAMS, f"unknown language: {names[0]}")
        options = Options(globs=tuple([given["glob"]] if given.get("glob") else []), languages=tuple(names), project_root=self.root)
        roots = [given["path"]] if given.get("path") else []
        try:
            if name == "outline":
                return _text(self.shown(api.outline(self.spark, roots, kinds=kinds, options=options, keep=True), survey=True))
            case = Case.INSENSITIVE if given.get("case_insensitive") else Case.SENSITIVE
            found = api.search(self.spark, [given["pattern"]], roots, kinds=kinds, case=case, word=bool(given.get("word_match")), options=options, keep=True)
        except ValueError as e:
            raise Failure(PARAMS, str(e)) from None
        if given.get("head_limit") is not None:
            found = api.Result(ops.head(found.defs, int(given["head_limit"])), found.errors)
        return _text(self.shown(found))

    def shown(self, found: api.Result, survey: bool = False) -> str:
        """Lines relative to the project's root, then the errors."""
        rel = ops.text.relative(F.col("path"), self.root)
        lines = api.text_lines(api.Result(found.defs.withColumn("path", rel), found.errors), survey=survey) or ["No definitions found."]
        errors = [f"{r['path']}: {r['message']}" for r in found.errors.withColumn("path", rel).toLocalIterator()]
        return "\n".join(lines + (["--- errors ---", *errors] if errors else []))


def _text(content: str, failed: bool = False) -> dict:
    return {"content": [{"type": "text", "text": content}]} | ({"isError": True} if failed else {})


def parsed(lines: DataFrame) -> DataFrame:
    """Requests (column ``value``) with the error code that their frame alone earns, null if it is sound."""
    frame = F.from_json("value", "jsonrpc string, id string, method string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    known = ["initialize", "notifications/initialized", "tools/list", "tools/call", "ping"]
    code = (
        F.when(F.col("f._bad").isNotNull() | F.col("f").isNull(), PARSE)
        .when(~F.col("f.jsonrpc").eqNullSafe("2.0") | F.col("f.method").isNull(), INVALID)
        .when(~F.col("f.method").isin(known), METHOD)
    )
    return lines.withColumn("f", frame).select("value", F.col("f.id").alias("id"), F.col("f.method").alias("method"), code.alias("code"))


def serve(session: Session, requests: DataFrame, respond):
    """Answers a stream of request lines batch by batch, in the order of the lines; returns the running query."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.toLocalIterator():
            if (out := session.answer(r["value"])) is not None:
                respond(out)

    return requests.writeStream.foreachBatch(each).start()
