"""The tools of a project over HTTP, with the payloads of the API."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from loomgraph.api import NotFound, Project
from loomgraph.render import TOOL, VERSION

MAX_BODY = 1 << 20

#: Tool: its arguments.
TOOLS = {
    "query": ("sql", "summary", "changed_since", "group_by", "format"), "query_recipe": ("recipe", "params", "summary", "changed_since", "group_by", "format"), "query_batch": ("statements", "summary", "changed_since", "group_by"),
    "audit": ("baseline_prefix", "base", "baselines", "summary", "no_index"), "context": ("compact", "intent"), "validate": ("paths",), "save_baseline": ("name", "sql", "recipe"), "list_baselines": (), "drop_baseline": ("name",),
    "show": ("name", "kind", "in"), "snippet": ("name", "kind", "in"), "impact": ("target", "direction", "via", "depth", "limit", "summary"),
}


class ToolError(ValueError):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def call(project: Project, tool: str, args: dict) -> object:
    """Run a tool; ToolError with an HTTP status if it can't."""
    if tool not in TOOLS:
        raise ToolError(404, f"no tool named {tool!r}")
    if not isinstance(args, dict):
        raise ToolError(400, "arguments are an object")
    if odd := sorted(set(args) - set(TOOLS[tool])):
        raise ToolError(400, f"{tool} has no argument {', '.join(odd)}")
    a = dict(args)
    if "format" in a:
        a["fmt"] = a.pop("format")
    if "in" in a:
        a["within"] = a.pop("in")
    try:
        if tool in ("query", "query_recipe"):
            need = "sql" if tool == "query" else "recipe"
            if not a.get(need):
                raise ToolError(400, f"{tool} needs {need}")
            if need == "recipe":
                project.recipe(a["recipe"])
            found = project.query(**a)
        elif tool == "query_batch":
            found = project.query_batch(a.pop("statements"), **a)
        elif tool == "audit":
            found = project.audit(a.get("baselines"), a.get("baseline_prefix"), a.get("base"), bool(a.get("summary")), bool(a.get("no_index")))
        elif tool == "validate":
            found = project.validate(a.get("paths"))
        elif tool == "list_baselines":
            found = project.store.baselines()
        elif tool == "drop_baseline":
            if not project.store.drop_baseline(a["name"]):
                raise ToolError(404, f"no baseline named {a['name']!r}")
            found = {"dropped": a["name"]}
        else:
            found = getattr(project, tool)(**a)
    except NotFound as e:
        raise ToolError(404, str(e)) from e
    except (KeyError, TypeError, ValueError) as e:
        if isinstance(e, ToolError):
            raise
        raise ToolError(400, str(e)) from e
    if isinstance(found, dict) and "error" in found:
        raise ToolError(400, found["error"])
    return found


def serve(project: Project, host: str = "127.0.0.1", port: int = 7878, token: str | None = None) -> ThreadingHTTPServer:
    """A server that isn't running yet."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, value: object) -> None:
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _refused(self) -> bool:
            """Another site's page may not call, nor anyone without the token if there is one."""
            origin = self.headers.get("Origin")
            own = {f"http://{self.headers.get('Host')}", f"http://localhost:{self.server.server_address[1]}", f"http://127.0.0.1:{self.server.server_address[1]}"}
            if origin and origin not in own or self.headers.get("Sec-Fetch-Site") == "cross-site":
                self._send(403, {"error": "requests of other sites are refused"})
                return True
            if token and self.path != "/health" and not hmac.compare_digest(self.headers.get("Authorization") or "", f"Bearer {token}"):
                self._send(401, {"error": "a token is needed"})
                return True
            return False

        def do_GET(self) -> None:
            if self._refused():
                return
            path = urlparse(self.path).path
            if path == "/health":
                return self._send(200, {"ok": True, "version": VERSION})
            if path == "/tools":
                return self._send(200, {"tools": [{"name": n, "arguments": list(v)} for n, v in TOOLS.items()]})
            if path == "/resources":
                return self._send(200, {"resources": [f"{TOOL}://{x}" for x in ("recipes", "recipes/{id}", "schema", "files/{path}", "symbols/{name}", "guide")]})
            if path.startswith("/resources/"):
                try:
                    return self._send(200, project.resource(unquote(path[11:]).removeprefix(f"{TOOL}://")))
                except NotFound as e:
                    return self._send(404, {"error": str(e)})
            self._send(404, {"error": "no such page"})

        def do_POST(self) -> None:
            if self._refused():
                return
            path = urlparse(self.path).path
            if not path.startswith("/tool/"):
                return self._send(404, {"error": "no such page"})
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self.close_connection = True
                for _ in range(min(size, 8 * MAX_BODY) // 65_536 + 1):  # read on, so that a client that is still sending gets the answer
                    if not self.rfile.read(min(65_536, size)):
                        break
                    size -= 65_536
                    if size <= 0:
                        break
                return self._send(413, {"error": "the body is too large"})
            try:
                self._send(200, call(project, path[6:], json.loads(self.rfile.read(size) or b"{}")))
            except json.JSONDecodeError as e:
                self._send(400, {"error": f"not JSON: {e}"})
            except ToolError as e:
                self._send(e.status, {"error": str(e)})
            except Exception as e:
                self._send(500, {"error": str(e).split("\n\n")[0]})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
