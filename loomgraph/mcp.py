"""The tools and resources of a project for a model's client: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
from typing import TextIO

from loomgraph.api import NotFound, Project
from loomgraph.render import TOOL, VERSION
from loomgraph.serve import TOOLS, ToolError, call

PROTOCOL = "2024-11-05"
RESOURCES = ("recipes", "schema", "guide")
TEMPLATES = ("recipes/{id}", "files/{path}", "symbols/{name}")

_KINDS = {
    "summary": {"type": "boolean"}, "compact": {"type": "boolean"}, "no_index": {"type": "boolean"}, "params": {"type": "object"}, "baselines": {"type": "object"},
    "statements": {"type": "array"}, "paths": {"type": "array", "items": {"type": "string"}}, "depth": {"type": "integer", "minimum": 0}, "limit": {"type": "integer", "minimum": 1},
}
_NEEDED = {"query": ["sql"], "query_recipe": ["recipe"], "query_batch": ["statements"], "drop_baseline": ["name"], "show": ["name"], "snippet": ["name"], "impact": ["target"]}


class RpcError(Exception):
    def __init__(self, code: int, text: str):
        super().__init__(text)
        self.code = code


def tools() -> list[dict]:
    return [
        {"name": n, "inputSchema": {"type": "object", "properties": {a: _KINDS.get(a, {"type": "string"}) for a in args}, "required": _NEEDED.get(n, []), "additionalProperties": False}}
        for n, args in TOOLS.items()
    ]


def _text(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, default=str)


def answer(project: Project, method: str, params: dict) -> dict:
    """The result of a request; RpcError if there is none."""
    if method == "initialize":
        return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": TOOL, "version": VERSION}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": tools()}
    if method == "tools/call":
        try:
            found, failed = call(project, params.get("name", ""), params.get("arguments") or {}), False
        except ToolError as e:
            if e.status == 404 and params.get("name") not in TOOLS:
                raise RpcError(-32602, str(e)) from e
            found, failed = {"error": str(e)}, True
        return {"content": [{"type": "text", "text": _text(found)}], "isError": failed}
    if method == "resources/list":
        return {"resources": [{"uri": f"{TOOL}://{r}", "name": r, "mimeType": "text/plain" if r == "guide" else "application/json"} for r in RESOURCES]}
    if method == "resources/templates/list":
        return {"resourceTemplates": [{"uriTemplate": f"{TOOL}://{r}", "name": r, "mimeType": "application/json"} for r in TEMPLATES]}
    if method == "resources/read":
        uri = params.get("uri", "")
        try:
            found = project.resource(uri.removeprefix(f"{TOOL}://"))
        except NotFound as e:
            raise RpcError(-32002, str(e)) from e
        return {"contents": [{"uri": uri, "mimeType": "text/plain" if isinstance(found, str) else "application/json", "text": _text(found)}]}
    raise RpcError(-32601, f"no method {method!r}")


def reply(project: Project, line: str) -> dict | None:
    """What a message is answered with; None for a notification."""
    try:
        message = json.loads(line)
    except json.JSONDecodeError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"not JSON: {e}"}}
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": -32600, "message": "not a request"}}
    if "id" not in message:
        return None
    head = {"jsonrpc": "2.0", "id": message["id"]}
    try:
        return head | {"result": answer(project, message["method"], message.get("params") or {})}
    except RpcError as e:
        return head | {"error": {"code": e.code, "message": str(e)}}
    except Exception as e:
        return head | {"error": {"code": -32603, "message": str(e).split("\n\n")[0]}}


def run(project: Project, lines: TextIO, out: TextIO) -> None:
    """Answer until the input ends."""
    for line in lines:
        if line.strip() and (found := reply(project, line)) is not None:
            out.write(json.dumps(found, default=str) + "\n")
            out.flush()
