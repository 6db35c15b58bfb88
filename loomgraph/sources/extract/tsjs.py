"""Facts of a TypeScript or JavaScript file: symbols, imports, exports, components, calls, type members.

A recursive descent over tokens that knows declarations, scopes, classes and types, and walks through
expressions only to find calls, branches, functions and elements in them.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right

from loomgraph.sources.extract.lexer import Lexer, SyntaxProblem, Token

_OPEN = {"(": ")", "[": "]", "{": "}", "`(": "`)"}
_CLOSERS = set(_OPEN.values())
_COMPONENT, _HOOK = re.compile(r"[A-Z]"), re.compile(r"use[A-Z]")
_VISIBILITY = re.compile(r"^\s*@(alpha|beta|internal|private|public)\b", re.M | re.A)
_SIMPLE_TYPES = {"string", "number", "boolean", "void", "null", "undefined", "any", "never", "unknown", "object", "bigint", "symbol", "this"}
_NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "import", "await", "new", "with", "void", "delete", "throw", "case", "in", "of", "instanceof", "else", "do", "yield", "class", "extends"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "get", "set", "accessor"}
_GOES_ON = {"instanceof", "in", "as", "satisfies", "of", "extends"}
_DECLARES = {"interface", "type", "enum", "namespace", "module", "abstract", "declare"}


class Extractor:
    def __init__(self, source: str, extension: str):
        self.source, self.jsx = source, extension in (".tsx", ".jsx")
        lexer = Lexer(source, self.jsx or extension in (".js", ".mjs", ".cjs"))
        self.t: list[Token] = lexer.run()
        self.lines = [0] + [m.end() for m in re.finditer("\n", source)]
        self.docs = [(b, self._clean(source[a + 2 : b - 2])) for a, b in lexer.comments if source.startswith("/**", a) and b - a > 4]
        self.doc_ends = [b for b, _ in self.docs]
        self.close = self._matches()
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.exports: list[dict] = []
        self.components: list[dict] = []
        self.calls: list[dict] = []
        self.type_members: list[dict] = []
        self.named: set[str] = set()
        self.default: set[str] = set()
        self.scope: list[str] = []
        self.counters: list[list[int]] = []  # [symbol or -1, branches + 1]
        self.component: str | None = None
        self.hooks: dict[str, dict[str, None]] = {}
        self.drawn: set[str] = set()
        self.called: set[tuple[str, str]] = set()

    def run(self) -> dict[str, list[dict]]:
        self._exports()
        self._block(0, len(self.t) - 1)
        for s in self.symbols:
            m = _VISIBILITY.search(s["doc_comment"] or "")
            s["visibility"] = m[1] if m else None
        return {k: getattr(self, k) for k in ("symbols", "imports", "exports", "components", "calls", "type_members")}

    # Places

    def _matches(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "punct":
                if t.text in _OPEN:
                    stack.append(i)
                elif t.text in _CLOSERS:
                    if not stack or _OPEN[self.t[stack[-1]].text] != t.text:
                        raise SyntaxProblem(f"{t.text} at {t.start} closes nothing")
                    out[stack.pop()] = i
        if stack:
            raise SyntaxProblem("open bracket")
        return out

    def _line(self, offset: int) -> int:
        return bisect_right(self.lines, offset)

    @staticmethod
    def _clean(body: str) -> str:
        return "\n".join(re.sub(r"^\s*\*\s?", "", line) for line in body.split("\n")).strip()

    def _doc(self, offset: int) -> str | None:
        k = bisect_right(self.doc_ends, offset) - 1
        if k < 0 or re.search("[;{}]", self.source[self.doc_ends[k] : offset]):
            return None
        return self.docs[k][1] or None

    def _is(self, i: int, *texts: str) -> bool:
        t = self.t[i]
        return t.text in texts and t.kind in ("id", "punct")

    # Rows

    def _symbol(self, name: str, kind: str, start: int, end: int, signature: str, parent: str | None, **more) -> int:
        """start and end are tokens, the last inclusive."""
        a, b = self.t[start].start, self.t[max(start, end)].end
        row = {"name": name, "kind": kind, "line_start": self._line(a), "line_end": self._line(max(a, b - 1)), "signature": signature, "is_exported": 0, "is_default_export": 0, "members": None, "doc_comment": self._doc(a), "value": None, "parent_name": parent, "visibility": None, "complexity": None}
        self.symbols.append(row | more)
        return len(self.symbols) - 1

    def _exported(self, name: str, types: bool = False) -> dict:
        if types:
            return {"is_exported": int(name in self.named)}
        return {"is_exported": int(name in self.named or name in self.default), "is_default_export": int(name in self.default)}

    def _parent(self) -> str | None:
        return self.scope[-1] if self.scope else None

    def _leave(self, name: str | None) -> None:
        if name and self.scope and self.scope[-1] == name:
            self.scope.pop()

    # Exports and imports: a first pass over the top level

    def _exports(self) -> None:
        i, end = 0, len(self.t) - 1
        while i < end:
            t = self.t[i]
            if t.kind == "punct" and t.text in _OPEN:
                i = self.close[i] + 1
                continue
            if t.kind == "id" and t.text == "export" and (not i or not self._is(i - 1, ".", "?.")):
                self._export(i + 1)
            i += 1

    def _put_export(self, name: str | None, local: str | None, types: bool, source: str | None, default: bool = False) -> None:
        if default:
            self.default |= {"default"} | ({local} if local else set())
        elif name:
            self.named.add(name)
        kind = "re-export" if source is not None else "type" if types else "value"
        self.exports.append({"name": "default" if default else name or local or "unknown", "kind": kind, "is_default": int(default), "re_export_source": source})

    def _export(self, i: int) -> None:
        if self._is(i, "default"):
            i += 1
            while self._is(i, "async", "abstract"):
                i += 1
            name = None
            if self._is(i, "function", "class", "interface"):
                i += 2 if self._is(i + 1, "*") else 1
                if self.t[i].kind == "id" and not self._is(i, "extends"):
                    name = self.t[i].text
            elif self.t[i].kind == "id" and self.t[i + 1].kind in ("end", "id") or self._is(i + 1, ";"):
                name = self.t[i].text if self.t[i].kind == "id" else None
            self._put_export(None, name, False, None, True)
            return
        types = self._is(i, "type") and self._is(i + 1, "{", "*")
        i += types
        if self._is(i, "*"):
            name = None
            if self._is(i + 1, "as"):
                name, i = self.t[i + 2].text, i + 2
            self._put_export(name, None, types, self.t[i + 2].text)
        elif self._is(i, "{"):
            stop = self.close[i]
            source = self.t[stop + 2].text if self._is(stop + 1, "from") and self.t[stop + 2].kind == "str" else None
            for part in self._parts(i + 1, stop):
                own = types
                if len(part) > 1 and self.t[part[0]].text == "type" and self.t[part[1]].text != "as":
                    own, part = True, part[1:]
                local, name = self.t[part[0]].text, self.t[part[-1]].text
                self._put_export(name, local, own, source, name == "default")
        elif self._is(i, "=", "as", "import"):
            return
        else:
            types = self._is(i, "interface", "type", "declare")
            while self._is(i, "declare", "async", "abstract"):
                i += 1
            if self._is(i, "const") and self._is(i + 1, "enum"):
                i += 1
            if self._is(i, "const", "let", "var"):
                for name, _, _ in self._declarators(i + 1)[0]:
                    self._put_export(name, name, types, None)
            else:
                i += 2 if self._is(i + 1, "*") else 1
                self._put_export(self.t[i].text, self.t[i].text, types, None)

    def _parts(self, i: int, stop: int) -> list[list[int]]:
        """Token indexes between commas of one level."""
        out: list[list[int]] = [[]]
        while i < stop:
            if self._is(i, ","):
                out.append([])
                i += 1
                continue
            out[-1].append(i)
            if self.t[i].kind == "punct" and self.t[i].text in _OPEN:
                out[-1] += range(i + 1, self.close[i] + 1)
                i = self.close[i]
            i += 1
        return [p for p in out if p]

    def _import(self, i: int) -> int:
        start = i
        i += 1
        entries: list[tuple[str, bool]] = []
        whole = self._is(i, "type") and not self._is(i + 1, "from", ",") or self._is(i, "type") and self._is(i + 1, "from") and self._is(i + 2, "from")
        if whole:
            i += 1
        if self.t[i].kind != "str":
            if self.t[i].kind == "id" and not self._is(i, "from") or self._is(i, "from") and self._is(i + 1, "from", ","):
                if self._is(i + 1, "="):  # import x = require(...)
                    return self._expression(i + 2)
                entries.append((self.t[i].text, whole))
                i += 1
                i += self._is(i, ",")
            if self._is(i, "*"):
                entries.append((f"* as {self.t[i + 2].text}", whole))
                i += 3
            elif self._is(i, "{"):
                for part in self._parts(i + 1, self.close[i]):
                    own = whole
                    if len(part) > 1 and self.t[part[0]].text == "type" and not (len(part) == 3 and self.t[part[1]].text == "as"):
                        own, part = True, part[1:]
                    a, b = self.t[part[0]].text, self.t[part[-1]].text
                    entries.append((b if a == "default" and a == b else a if a == b else f"{a} as {b}", own))
                i = self.close[i] + 1
            i += 1  # from
        if self.t[i].kind != "str":
            raise SyntaxProblem(f"import without a source at {self.t[start].start}")
        only = bool(entries) and all(own for _, own in entries)
        self.imports.append({"source": self.t[i].text, "resolved_path": None, "specifiers": json.dumps([e for e, _ in entries], ensure_ascii=False, separators=(",", ":")), "is_type_only": int(only), "line_number": self._line(self.t[start].start)})
        i += 1
        if self._is(i, "with", "assert") and self._is(i + 1, "{"):
            i = self.close[i + 1] + 1
        return i + self._is(i, ";")

    # Statements

    def _block(self, i: int, end: int) -> None:
        while i < end:
            i = max(i + 1, self._statement(i, end))

    def _statement(self, i: int, end: int) -> int:
        """Past the statement at i."""
        t = self.t[i]
        if t.kind != "id":
            if self._is(i, "{"):
                self._block(i + 1, self.close[i])
                return self.close[i] + 1
            if self._is(i, "@"):
                return self._decorator(i)
            return i + 1 if self._is(i, ";", "}") else self._expression(i)
        word, after = t.text, i + 1
        if word == "import" and not self._is(after, "(", "."):
            return self._import(i)
        if word == "export":
            if self._is(after, "default"):
                after += 1
                return self._statement(after, end) if self._is(after, "function", "class", "abstract", "async", "interface", "@") else self._expression(after)
            if self._is(after, "type") and self._is(after + 1, "{", "*"):
                after += 1
            if self._is(after, "{", "*", "=", "as"):
                while after < end and not self._is(after, ";") and not (self.t[after].fresh and after > i + 1):
                    after = self.close.get(after, after) + 1
                return after + self._is(after, ";")
            return self._statement(after, end)
        if word == "function" or word == "async" and self._is(after, "function") and not self.t[after].fresh:
            return self._function(i)
        if word == "class" or word == "abstract" and self._is(after, "class"):
            return self._class(i, True)
        if word in _DECLARES and self.t[after].kind in ("id", "str") and not self.t[after].fresh:
            if word == "interface":
                return self._interface(i)
            if word == "type":
                return self._alias(i)
            if word == "enum":
                return self._enum(i, i)
            if word in ("namespace", "module", "declare"):
                if word == "declare":
                    return self._statement(after, end) if not self._is(after, "global") else self._statement(after + 1, end)
                while not self._is(after, "{", ";") and after < end and not (self.t[after].fresh and after > i + 1):
                    after += 1
                return self._statement(after, end) if self._is(after, "{") else after
        if word in ("const", "let", "var") and (self.t[after].kind == "id" or self._is(after, "{", "[")):
            if word == "const" and self._is(after, "enum"):
                return self._enum(i, after)
            return self._variables(i)
        if word in ("if", "while", "for", "switch", "catch", "with"):
            if word in ("if", "while", "for", "catch"):
                self._branch()
            if self._is(after, "await"):
                after += 1
            if self._is(after, "("):
                self._head(after)
                after = self.close[after] + 1
            if word == "switch" and self._is(after, "{"):
                self._cases(after + 1, self.close[after])
                return self.close[after] + 1
            return self._statement(after, end) if after < end else after
        if word == "do":
            self._branch()
            after = self._statement(after, end)
            if self._is(after, "while") and self._is(after + 1, "("):
                self._walk(after + 2, self.close[after + 1])
                after = self.close[after + 1] + 1
            return after + self._is(after, ";")
        if word in ("else", "try", "finally") and not self._is(after, ":", "."):
            return self._statement(after, end)
        if word in ("return", "throw") and self.t[after].fresh:
            return after
        if word in ("break", "continue", "debugger", "return", "throw"):
            return after + 1 if self._is(after, ";") else self._expression(after) if word in ("return", "throw") else after
        if self._is(after, ":") and word not in ("case", "default"):  # a label
            return after + 1
        return self._expression(i)

    def _head(self, i: int) -> None:
        """The parenthesis of a statement; a for loop may declare in it."""
        stop = self.close[i]
        k = i + 1
        if self._is(k, "const", "let", "var"):
            k = self._variables(k, stop)
        self._walk(k, stop)

    def _cases(self, i: int, stop: int) -> None:
        while i < stop:
            if self._is(i, "case"):
                self._branch()
                k, nested = i + 1, 0
                while k < stop and not (self._is(k, ":") and not nested):
                    nested += self._is(k, "?")
                    nested -= self._is(k, ":")
                    k = self.close.get(k, k) + 1
                self._walk(i + 1, k)
                i = k + 1
            elif self._is(i, "default") and self._is(i + 1, ":"):
                i += 2
            else:
                i = max(i + 1, self._statement(i, stop))

    def _branch(self) -> None:
        if self.counters:
            self.counters[-1][1] += 1

    def _enter(self, symbol: int) -> None:
        self.counters.append([symbol, 1])

    def _exit(self) -> None:
        if self.counters:
            symbol, count = self.counters.pop()
            if symbol >= 0:
                self.symbols[symbol]["complexity"] = float(count)

    # Functions

    def _type_parameters(self, i: int) -> tuple[str, int]:
        if not self._is(i, "<"):
            return "", i
        parts, i = [], i + 1
        while not self._is(i, ">") and self.t[i].kind != "end":
            while self._is(i, "const", "in", "out") and self.t[i + 1].kind == "id":
                i += 1
            text, i = self.t[i].text, i + 1
            if self._is(i, "extends"):
                kind, i = self._type(i + 1)
                text += f" extends {kind}" if kind else ""
            if self._is(i, "="):
                kind, i = self._type(i + 1)
                text += f" = {kind}" if kind else ""
            parts.append(text)
            if not self._is(i, ",", ">"):
                i += 1
            i += self._is(i, ",")
        return f"<{', '.join(parts)}>" if parts else "", i + 1

    def _signature(self, i: int) -> dict:
        """Type parameters, parameters and return type from i on."""
        generics, i = self._type_parameters(i)
        if not self._is(i, "("):
            raise SyntaxProblem(f"parameters expected at {self.t[i].start}")
        stop, names, props, defaults = self.close[i], [], None, []
        for n, part in enumerate(self._parts(i + 1, stop)):
            k, name = part[0], "..."
            while self._is(k, "@"):
                k = self._decorator(k)
            if self._is(k, "..."):
                name = self.t[k + 1].text if self.t[k + 1].kind == "id" else "..."
                k += 2
            elif self.t[k].kind == "id" and not (self._is(k, "public", "private", "protected", "readonly", "override") and self.t[k + 1].kind == "id"):
                name = self.t[k].text
                k += 1
            else:
                while self.t[k].kind == "id" and self.t[k + 1].kind == "id":
                    k += 1
                k = self.close.get(k, k) + 1
            k += self._is(k, "?")
            has_default = False
            if self._is(k, ":") and k <= part[-1]:
                simple = self.t[k + 1].text if self.t[k + 1].kind == "id" and self.t[k + 1].text not in _SIMPLE_TYPES | {"keyof", "typeof", "readonly"} and not self._is(k + 2, ".") else None
                at = k + 1
                text, k = self._type(k + 1)
                if n == 0 and simple and text and re.fullmatch(rf"{re.escape(simple)}(<.*>)?", text) and not self._is(at - 1, "=>"):
                    props = simple
            if self._is(k, "=") and k <= part[-1]:
                has_default = True
                defaults.append((k + 1, part[-1] + 1))
            if n == 0 and has_default:
                props = None
            names.append(name)
        k, returns = stop + 1, None
        if self._is(k, ":"):
            returns, k = self._type(k + 1)
        text = f"{generics}({', '.join(names)})" + (f": {returns}" if returns else "")
        return {"text": text, "names": names, "props": props, "returns": returns, "defaults": defaults, "next": k}

    def _body(self, i: int, sig: dict) -> int:
        """Default values, then the block at i."""
        for a, b in sig["defaults"]:
            self._walk(a, b)
        self._block(i + 1, self.close[i])
        return self.close[i] + 1

    def _function(self, start: int) -> int:
        """A function declaration."""
        i = start + (self.t[start].text == "async") + 1
        i += self._is(i, "*")
        name = None
        if self.t[i].kind == "id":
            name, i = self.t[i].text, i + 1
        sig = self._signature(i)
        if not self._is(sig["next"], "{"):  # an overload has no body
            return sig["next"] + self._is(sig["next"], ";")
        stop = self.close[sig["next"]]
        if name is None:
            self._enter(-1)
            self._body(sig["next"], sig)
            self._exit()
            return stop + 1
        self._enter(self._symbol(name, "function", start, stop, name + sig["text"], self._parent(), **self._exported(name)))
        self.scope.append(name)
        self._begin_component(name)
        self._body(sig["next"], sig)
        self._leave(name)
        self._exit()
        self._end_component(name, sig["props"])
        return stop + 1

    def _begin_component(self, name: str) -> None:
        if self.jsx and _COMPONENT.match(name):
            self.component = name
            self.hooks[name] = {}

    def _end_component(self, name: str, props: str | None) -> None:
        if self.component != name:
            return
        hooks = self.hooks.get(name, {})
        if name in self.drawn or hooks:
            self.components.append({"name": name, "props_type": props, "hooks_used": json.dumps(list(hooks), separators=(",", ":")), "is_default_export": int(name in self.default)})
        self.component = None

    def _arrow(self, i: int) -> int | None:
        """If an arrow function starts at i, its => token."""
        k = i + 1 if self._is(i, "async") and not self.t[i + 1].fresh and (self.t[i + 1].kind == "id" or self._is(i + 1, "(", "<")) else i
        if self.t[k].kind == "id" and self._is(k + 1, "=>"):
            return k + 1
        if self._is(k, "<"):
            depth, j = 0, k
            while self.t[j].kind != "end" and j < k + 200:
                depth += self._is(j, "<")
                depth -= self._is(j, ">")
                j += 1
                if not depth:
                    break
            k = j
        if not self._is(k, "("):
            return None
        j = self.close[k] + 1
        if self._is(j, "=>"):
            return j
        if self._is(j, ":"):
            before = len(self.type_members)
            try:
                _, j = self._type(j + 1)
            except (SyntaxProblem, IndexError):
                return None
            finally:
                del self.type_members[before:]
            if self._is(j, "=>"):
                return j
        return None

    def _arrow_body(self, i: int, arrow: int, symbol: int, limit: int) -> tuple[int, dict]:
        """Walk an arrow function; past its end, and its signature."""
        k = i + 1 if self._is(i, "async") and i + 1 < arrow else i
        if self.t[k].kind == "id":
            sig = {"text": f"({self.t[k].text})", "names": [self.t[k].text], "props": None, "returns": None, "defaults": [], "next": arrow}
        else:
            sig = self._signature(k)
        self._enter(symbol)
        if self._is(arrow + 1, "{"):
            end = self._body(arrow + 1, sig)
        else:
            for a, b in sig["defaults"]:
                self._walk(a, b)
            end = self._operand_end(arrow + 1, limit)
            self._walk(arrow + 1, end)
        self._exit()
        return end, sig

    # Expressions

    def _ends_operand(self, i: int) -> bool:
        t = self.t[i]
        return t.kind in ("num", "str", "tpl", "regex") or t.kind == "jsx" and t.text == ">" or t.kind == "id" and t.text not in _GOES_ON | {"return", "typeof", "new", "await", "void", "delete", "yield", "case"} or t.kind == "punct" and t.text in (")", "]", "}", "`)", "++", "--")

    def _breaks(self, i: int) -> bool:
        """Whether a statement may end before the token at i, which starts a line."""
        t = self.t[i]
        if not t.fresh or not self._ends_operand(i - 1):
            return False
        if t.kind == "id":
            return t.text not in _GOES_ON
        return t.kind in ("num", "str", "regex") or t.text in ("{", "@", "++", "--", "~", "!") or t.kind == "jsx" and t.text == "<"

    def _expression_end(self, i: int, limit: int) -> int:
        """Where the statement's expression from i ends: at a semicolon, or a line that can't go on."""
        first = i
        while i < limit:
            if self._is(i, ";", "}", ")", "]"):
                return i
            if i > first and self._breaks(i):
                return i
            i = self._skip(i)
        return limit

    def _operand_end(self, i: int, limit: int) -> int:
        """As before, and a comma ends it too."""
        first = i
        while i < limit:
            if self._is(i, ";", ",", "}", ")", "]", "`)") or i > first and self._breaks(i):
                return i
            i = self._skip(i)
        return limit

    def _skip(self, i: int) -> int:
        if self.t[i].kind == "jsx" and self.t[i].text == "<":
            depth = 0
            while True:
                if self.t[i].kind == "jsx":
                    depth += 1 if self.t[i].text == "<" else -1
                i += 1
                if not depth or self.t[i].kind == "end":
                    return i
        return self.close.get(i, i) + 1

    def _expression(self, i: int) -> int:
        end = self._expression_end(i, len(self.t) - 1)
        self._walk(i, end)
        return end + self._is(end, ";") if end > i else i + 1

    def _decorator(self, i: int) -> int:
        i += 1
        while self.t[i].kind == "id" or self._is(i, "."):
            i += 1
            if self.t[i].kind == "id" and not self._is(i - 1, "."):
                break
        if self._is(i, "("):
            self._walk(i, self.close[i] + 1)
            i = self.close[i] + 1
        return i

    def _walk(self, i: int, end: int) -> None:
        """Find calls, branches, functions, classes and elements in the tokens of expressions."""
        while i < end:
            t = self.t[i]
            member = i > 0 and self._is(i - 1, ".", "?.")
            if t.kind == "jsx":
                if t.text == "<" and self.component:
                    self.drawn.add(self.component)
            elif t.kind == "id" and not member:
                if (t.text == "function" or t.text == "async" and self._is(i + 1, "function")) and not self._is(i + 1, ":", ",", "=", ")", "}"):
                    k = i + (t.text == "async") + 1
                    k += self._is(k, "*")
                    k += self.t[k].kind == "id"
                    sig = self._signature(k)
                    self._enter(-1)
                    i = self._body(sig["next"], sig) if self._is(sig["next"], "{") else sig["next"]
                    self._exit()
                    continue
                if t.text == "class" and not self._is(i + 1, ":", ",", "=", ")", "."):
                    i = self._class(i, False)
                    continue
                if (arrow := self._arrow(i)) is not None:
                    i, _ = self._arrow_body(i, arrow, -1, end)
                    continue
                if t.text in ("as", "satisfies") and i and self._ends_operand(i - 1) and not self.t[i].fresh and not self._is(i + 1, "(", ",", ")", ".", "=", ";", ":"):
                    i = i + 2 if self._is(i + 1, "const") else self._type(i + 1)[1]
                    continue
                self._call(i)
            elif t.kind == "id":
                self._call(i)
            elif t.text in ("&&", "||", "??"):
                self._branch()
            elif t.text == "?" and not self._is(i + 1, ":", ")", ",", "(") or t.text == "?" and self._is(i + 1, "("):
                self._branch()
            elif t.text in ("(", "<") and (arrow := self._arrow(i)) is not None and (t.text == "(" or i + 1 < arrow):
                if t.text == "(" or not self._ends_operand(i - 1):
                    i, _ = self._arrow_body(i, arrow, -1, end)
                    continue
            elif t.text == "{":
                i = self._object(i)
                continue
            i += 1

    def _object(self, i: int) -> int:
        """An object literal, or the braces of an element: methods in it are functions of their own."""
        stop = self.close[i]
        k = i + 1
        while k < stop:
            j = k
            while self._is(j, "async", "get", "set", "*") and not self._is(j + 1, "(", ",", ":", "}"):
                j += 1
            named = self.t[j].kind in ("id", "str", "num")
            after = self.close[j] + 1 if self._is(j, "[") else j + 1
            if (named or self._is(j, "[")) and self._is(after, "(") and not (self.t[j].kind == "id" and self.t[j].text in _NOT_CALLED) and (k == i + 1 or self._is(k - 1, ",")):
                try:
                    sig = self._signature(after)
                except SyntaxProblem:
                    sig = None
                if sig and self._is(sig["next"], "{"):
                    self._enter(-1)
                    k = self._body(sig["next"], sig)
                    self._exit()
                    continue
            end = self._comma(k, stop)
            self._walk(k, end)
            k = end + 1
        return stop + 1

    def _comma(self, i: int, stop: int) -> int:
        while i < stop and not self._is(i, ","):
            i = self._skip(i)
        return min(i, stop)

    def _call(self, i: int) -> None:
        """Record the call whose callee ends at the name at i, if there is one."""
        name = self.t[i].text
        k = i + 1
        if self._is(k, "?."):
            k += 1
        if self._is(k, "<"):
            depth, j = 0, k
            while j < k + 60 and self.t[j].kind in ("id", "punct", "str", "num") and not self._is(j, ";", "&&", "||"):
                depth += self._is(j, "<")
                depth -= self._is(j, ">")
                j = self.close.get(j, j) + 1
                if not depth:
                    break
            k = j if not depth else k
        if not self._is(k, "("):
            return
        member = i > 0 and self._is(i - 1, ".", "?.")
        if not member:
            if name in _NOT_CALLED or i > 0 and self._is(i - 1, "new", "function"):
                return
            if self.component and _HOOK.match(name):
                self.hooks[self.component][name] = None
            callee = name
        else:
            owner = self.t[i - 2]
            lone = i < 3 or not self._is(i - 3, ".", "?.", "new")
            if owner.kind != "id" or not lone or owner.text == "super":
                return
            callee = f"{owner.text}.{name.lstrip('#')}"
        if not self.scope:
            return
        scope = ".".join(self.scope)
        if (scope, callee) not in self.called:
            self.called.add((scope, callee))
            self.calls.append({"caller_name": self.scope[-1], "caller_scope": scope, "callee_name": callee})

    # Variables

    def _declarators(self, i: int, limit: int | None = None) -> tuple[list[tuple[str | None, int, int]], int]:
        """(name, start and end of the initial value) of each, and the token past the last."""
        limit = len(self.t) - 1 if limit is None else limit
        out = []
        while i < limit:
            name = None
            if self.t[i].kind == "id":
                name, i = self.t[i].text, i + 1
            else:
                i = self.close.get(i, i) + 1
            i += self._is(i, "!")
            if self._is(i, ":"):
                i = self._type(i + 1)[1]
            if self._is(i, "="):
                end = self._operand_end(i + 1, limit)
                out.append((name, i + 1, end))
                i = end
            else:
                out.append((name, i, i))
            if not self._is(i, ","):
                break
            i += 1
        return out, i

    def _literal(self, a: int, b: int) -> str | None:
        for k in range(a, b):
            if self._is(k, "as", "satisfies"):
                b = k
                break
        while b - a > 2 and self._is(a, "(") and self.close[a] == b - 1:
            a, b = a + 1, b - 1
        sign = ""
        if b - a == 2 and self._is(a, "-") and self.t[a + 1].kind == "num":
            sign, a = "-", a + 1
        if b - a != 1:
            return None
        t = self.t[a]
        if t.kind == "num":
            return sign + _number(t.text)
        if t.kind in ("str", "tpl", "regex") or t.text in ("true", "false", "null"):
            return t.text
        return None

    def _variables(self, start: int, limit: int | None = None) -> int:
        found, end = self._declarators(start + 1, limit)
        last = end if self._is(end, ";") and limit is None else end - 1
        pushed: list[tuple[str | None, bool, str | None]] = []
        visits = []
        for name, a, b in found:
            arrow = self._arrow(a) if a < b else None
            whole = arrow is not None and (self._is(arrow + 1, "{") and self.close[arrow + 1] + 1 == b or not self._is(arrow + 1, "{"))
            plain = a < b and (self._is(a, "function") or self._is(a, "async") and self._is(a + 1, "function"))
            if plain:
                k = a + self._is(a, "async") + 1
                k += self._is(k, "*")
                sig = self._signature(k + (self.t[k].kind == "id"))
                plain = self._is(sig["next"], "{") and self.close[sig["next"]] + 1 == b
            elif whole:
                k = a + 1 if self._is(a, "async") and a + 1 < arrow else a
                sig = {"text": f"({self.t[k].text})", "props": None} if self.t[k].kind == "id" else self._signature(k)
            symbol = -1
            if name:
                own = {"is_exported": 0} | self._exported(name)
                if whole or plain:
                    symbol = self._symbol(name, "function", start, last, name + sig["text"], self._parent(), **own)
                    self.scope.append(name)
                    self._begin_component(name)
                else:
                    self._symbol(name, "const", start, last, f"const {name}", self._parent(), value=self._literal(a, b), **own)
            pushed.append((name, whole or plain, sig["props"] if whole or plain else None))
            visits.append((a, b, arrow if whole else None, sig if plain else None, symbol))
        for a, b, arrow, sig, symbol in visits:
            if arrow is not None:
                self._arrow_body(a, arrow, symbol, b)
            elif sig is not None:
                self._enter(symbol)
                self._body(sig["next"], sig)
                self._exit()
            else:
                self._walk(a, b)
        for name, is_function, props in reversed(pushed):
            if is_function:
                self._leave(name)
            if name:
                self._end_component(name, props)
        return end + (self._is(end, ";") if limit is None else 0)

    # Types

    def _type(self, i: int) -> tuple[str | None, int]:
        """The text of the type at i, null for kinds that aren't printed, and the token past it."""
        if self._is(i, "asserts") and self.t[i + 1].kind == "id":
            i += 1
        if self.t[i].kind == "id" and self._is(i + 1, "is") and not self.t[i + 1].fresh:
            return None, self._type(i + 2)[1]
        text, i = self._union(i)
        if self._is(i, "extends") and not self.t[i].fresh or self._is(i, "extends") and self.t[i].fresh:
            saved = i
            _, k = self._union(i + 1)
            if self._is(k, "?"):
                _, k = self._type(k + 1)
                if self._is(k, ":"):
                    _, k = self._type(k + 1)
                    return None, k
            return text, saved
        return text, i

    def _union(self, i: int) -> tuple[str | None, int]:
        return self._list(i, "|", lambda k: self._list(k, "&", self._prefix))

    def _list(self, i: int, sign: str, one) -> tuple[str | None, int]:
        leading = self._is(i, sign)
        text, i = one(i + leading)
        parts = [text]
        while self._is(i, sign):
            text, i = one(i + 1)
            parts.append(text)
        shown = [p for p in parts if p]
        return (f" {sign} ".join(shown) or None), i

    def _prefix(self, i: int) -> tuple[str | None, int]:
        if self._is(i, "keyof", "readonly", "unique") and not self._is(i + 1, ",", ">", ")", "=", ";", "|", "&", "[", "}") or self._is(i, "readonly"):
            inner, k = self._prefix(i + 1)
            return (f"{self.t[i].text} {inner}" if inner else None), k
        if self._is(i, "infer"):
            return None, i + 2
        text, i = self._primary(i)
        while self._is(i, "[") and not self.t[i].fresh:
            if self.close[i] == i + 1:
                text = f"{text}[]" if text else None
            else:
                text = None
            i = self.close[i] + 1
        return text, i

    def _arguments(self, i: int) -> tuple[str, int]:
        """Type arguments at i, if any."""
        if not self._is(i, "<"):
            return "", i
        parts, i = [], i + 1
        while not self._is(i, ">") and self.t[i].kind != "end":
            text, k = self._type(i)
            parts.append(text)
            i = max(k, i + 1)
            i += self._is(i, ",")
        shown = [p for p in parts if p]
        return (f"<{', '.join(shown)}>" if shown else ""), i + 1

    def _primary(self, i: int) -> tuple[str | None, int]:
        t = self.t[i]
        if self._is(i, "new", "abstract") and (self._is(i + 1, "(", "<", "new")):
            return None, self._type(i + 1)[1]
        if self._is(i, "(", "<"):
            k = i
            if self._is(i, "<"):
                _, k = self._type_parameters(i)
            after = self.close[k] + 1
            if self._is(after, "=>"):
                return None, self._type(after + 1)[1]
            text, _ = self._type(k + 1)
            return text, after
        if self._is(i, "{"):
            return None, self.close[i] + 1
        if self._is(i, "["):
            shown = []
            for part in self._parts(i + 1, self.close[i]):
                plain = not self._is(part[0], "...") and not (len(part) > 1 and self._is(part[1], ":", "?"))
                text = self._type(part[0])[0] if plain and not self._is(part[-1], "?") else None
                if text:
                    shown.append(text)
            return f"[{', '.join(shown)}]", self.close[i] + 1
        if t.kind in ("str", "num", "tpl"):
            return None, i + 1
        if self._is(i, "-"):
            return None, i + 2
        if self._is(i, "`("):
            return None, self.close[i] + 1
        if t.kind != "id":
            raise SyntaxProblem(f"type expected at {t.start}")
        if t.text in ("true", "false"):
            return None, i + 1
        if t.text == "typeof":
            name, i = self.t[i + 1].text, i + 2
            dotted = False
            while self._is(i, "."):
                dotted, i = True, i + 2
            if name == "import" and self._is(i, "("):
                i, dotted = self.close[i] + 1, True
                while self._is(i, "."):
                    i += 2
            _, i = self._arguments(i)
            return (None if dotted else f"typeof {name}"), i
        if t.text == "import" and self._is(i + 1, "("):
            i = self.close[i + 1] + 1
            while self._is(i, "."):
                i += 2
            return None, self._arguments(i)[1]
        names, i = [t.text], i + 1
        if t.text in _SIMPLE_TYPES and not self._is(i, ".", "<"):
            return t.text, i
        while self._is(i, "."):
            names.append(self.t[i + 1].text)
            i += 2
        arguments, i = self._arguments(i) if not self.t[i].fresh else ("", i)
        return (names[0] if len(names) == 1 else f"{'' if len(names) > 2 else names[0]}.{names[-1]}") + arguments, i

    def _bases(self, i: int, *stops: str) -> tuple[list[str], int]:
        out = []
        while not self._is(i, "{", *stops) and self.t[i].kind != "end":
            name, k, simple = self.t[i].text, i + 1, self.t[i].kind == "id"
            while self._is(k, ".", "("):
                simple, k = False, self.close.get(k, k) + 1 if self._is(k, "(") else k + 2
            arguments, k = self._arguments(k)
            if simple:
                out.append(name + arguments)
            i = k + self._is(k, ",")
            i = max(i, k)
        return out, i

    def _alias(self, start: int) -> int:
        name = self.t[start + 1].text
        generics, i = self._type_parameters(start + 2)
        if not self._is(i, "="):
            return self._expression(start)
        _, end = self._type(i + 1)
        last = end if self._is(end, ";") else end - 1
        self._symbol(name, "type", start, last, f"type {name}{generics}", self._parent(), **self._exported(name, True))
        if self._is(i + 1, "{") and self.close[i + 1] + 1 == end and not (self._is(i + 2, "[") and self._is(i + 4, "in")):
            self._members(name, i + 2, end - 1)
        return end + self._is(end, ";")

    def _interface(self, start: int) -> int:
        name = self.t[start + 1].text
        generics, i = self._type_parameters(start + 2)
        bases: list[str] = []
        if self._is(i, "extends"):
            bases, i = self._bases(i + 1)
        text = f"interface {name}{generics}" + (f" extends {', '.join(bases)}" if bases else "")
        self._symbol(name, "interface", start, self.close[i], text, self._parent(), **self._exported(name, True))
        self._members(name, i + 1, self.close[i])
        return self.close[i] + 1

    def _members(self, owner: str, i: int, stop: int) -> None:
        while i < stop:
            if self._is(i, ";", ","):
                i += 1
                continue
            fixed = 0
            if self._is(i, "readonly", "get", "set") and (self.t[i + 1].kind in ("id", "str") or self._is(i + 1, "[")):
                fixed, i = int(self._is(i, "readonly")), i + 1
            name = None
            if self.t[i].kind in ("id", "str", "num") and not self._is(i, "new") or self._is(i, "new") and self._is(i + 1, "?", ":"):
                name, i = self.t[i].text, i + 1
            elif self._is(i, "["):
                lone = self.close[i] == i + 2 and self.t[i + 1].kind == "id"
                name, i = (self.t[i + 1].text if lone else None), self.close[i] + 1
            elif self._is(i, "new"):
                i += 1
            optional = int(self._is(i, "?"))
            i += optional
            kind = None
            if self._is(i, "(", "<"):
                sig = self._signature(i)
                kind = f"({', '.join(sig['names'])})" + (f" => {sig['returns']}" if sig["returns"] else "")
                i = sig["next"]
            elif self._is(i, ":"):
                kind, i = self._type(i + 1)
            elif name is None:
                i += 1
            if name is not None:
                self.type_members.append({"symbol_name": owner, "name": name, "type": kind, "is_optional": optional, "is_readonly": fixed})

    def _enum(self, start: int, at: int) -> int:
        name, body = self.t[at + 1].text, at + 2
        members = []
        for part in self._parts(body + 1, self.close[body]):
            m: dict = {"name": self.t[part[0]].text}
            if len(part) == 3 and self._is(part[1], "="):
                v = self.t[part[2]]
                if v.kind == "str":
                    m["value"] = v.text
                elif v.kind == "num":
                    shown = _number(v.text)
                    m["value"] = int(shown) if re.fullmatch(r"-?\d+", shown) else float(shown)
            members.append(m)
        self._symbol(name, "enum", start, self.close[body], f"enum {name}", self._parent(), members=json.dumps(members, ensure_ascii=False, separators=(",", ":")) if members else None, **self._exported(name, True))
        return self.close[body] + 1

    # Classes

    def _class(self, start: int, declared: bool) -> int:
        i = start + (self.t[start].text == "abstract") + 1
        name = None
        if self.t[i].kind == "id" and not self._is(i, "extends", "implements"):
            name, i = self.t[i].text, i + 1
        generics, i = self._type_parameters(i)
        text = f"class {name}{generics}"
        if self._is(i, "extends"):
            a = i + 1
            bases, i = self._bases(a, "implements")
            text += f" extends {bases[0]}" if bases else ""
            self._walk(a, i)
        if self._is(i, "implements"):
            bases, i = self._bases(i + 1)
            text += f" implements {', '.join(bases)}" if bases else ""
        if not self._is(i, "{"):
            raise SyntaxProblem(f"class body expected at {self.t[i].start}")
        stop = self.close[i]
        named = declared and name
        if named:
            self._symbol(name, "class", start, stop, text, self._parent(), **self._exported(name))
            self.scope.append(name)
        visits: list[tuple] = []
        k = i + 1
        while k < stop:
            k = self._class_member(k, stop, name if named else None, visits)
        for key, sig, body, value in visits:
            if sig:
                if key:
                    self.scope.append(key)
                self._enter(-1)
                self._body(body, sig)
                self._exit()
                self._leave(key)
            elif value:
                self._walk(*value)
            else:
                self._block(body + 1, self.close[body])
        if named:
            self._leave(name)
        return stop + 1

    def _class_member(self, i: int, stop: int, owner: str | None, visits: list[tuple]) -> int:
        """Past the member at i; what is to be walked goes to visits, once all members are known."""
        if self._is(i, ";"):
            return i + 1
        while self._is(i, "@"):
            i = self._decorator(i)
        start, words = i, []
        while self.t[i].kind == "id" and self.t[i].text in _MODIFIERS and not self._is(i + 1, "(", "=", ":", ";", "?", "!", "<", "}") and not (self.t[i + 1].fresh and not self._is(i + 1, "*") and self.t[i].text in ("get", "set", "static", "async", "declare") and self.t[i + 1].kind != "id"):
            words.append(self.t[i].text)
            i += 1
        if words and words[-1] == "static" and self._is(i, "{"):
            visits.append((None, None, i, None))
            return self.close[i] + 1
        i += self._is(i, "*")
        key = None
        if self.t[i].kind == "id":
            key, i = self.t[i].text.lstrip("#"), i + 1
        elif self._is(i, "["):
            key, i = (self.t[i + 1].text if self.close[i] == i + 2 and self.t[i + 1].kind == "id" else None), self.close[i] + 1
        else:
            i += 1
        i += self._is(i, "?", "!")
        access = next((f"{w} " for w in words if w in ("private", "protected")), "")
        static = "static " if "static" in words else ""
        if self._is(i, "(", "<"):
            sig = self._signature(i)
            i = sig["next"]
            body = i if self._is(i, "{") else None
            end = self.close[i] if body is not None else i if self._is(i, ";") else i - 1
            if key and owner and "abstract" not in words:
                kind = "getter" if "get" in words else "setter" if "set" in words else "method"
                self._symbol(key, kind, start, end, f"{access}{static}{'async ' if 'async' in words else ''}{key}{sig['text']}", owner)
            if body is not None:
                visits.append((key, sig, body, None))
            return end + 1
        shown = None
        if self._is(i, ":"):
            shown, i = self._type(i + 1)
        value = None
        if self._is(i, "="):
            end = self._expression_end(i + 1, stop)
            value, i = (i + 1, end), end
        last = i if self._is(i, ";") else i - 1
        if key and owner and "abstract" not in words:
            fixed = "readonly " if "readonly" in words else ""
            self._symbol(key, "property", start, last, f"{access}{static}{fixed}{key}" + (f": {shown}" if shown else ""), owner, value=self._literal(*value) if value else None)
        if value:
            visits.append((key, None, None, value))
        return max(i + self._is(i, ";"), start + 1)


def _number(text: str) -> str:
    """A numeric literal as the language prints its value."""
    plain = text.replace("_", "")
    if plain.endswith("n"):
        return plain[:-1]
    value = int(plain, 0) if re.match("0[xXbBoO]", plain) else float(plain)
    return str(int(value)) if value == int(value) and abs(value) < 1e21 else repr(value)


def extract(source: str, extension: str) -> dict[str, list[dict]]:
    """Facts of a source text; SyntaxProblem if it can't be read."""
    try:
        return Extractor(source, extension).run()
    except (IndexError, KeyError, RecursionError) as e:
        raise SyntaxProblem(f"unreadable: {e!r}") from e
