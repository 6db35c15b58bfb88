"""Facts of a style sheet: custom properties, classes, keyframes and imports."""

from __future__ import annotations

import re

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_IMPORT = re.compile(r"@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)")
_NAMED = {"black": "#000", "white": "#fff", "red": "red"}


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def colour(value: str) -> str:
    """Hexadecimal colours as rgb() or rgba(); all else as it is, with single spaces."""

    def one(m: re.Match) -> str:
        h = m[1]
        if len(h) in (3, 4):
            h = "".join(c * 2 for c in h)
        r, g, b = (int(h[i : i + 2], 16) for i in (0, 2, 4))
        if len(h) == 8:
            alpha = f"{int(h[6:], 16) / 255:.3g}"
            return f"rgba({r}, {g}, {b}, {alpha})"
        return f"rgb({r}, {g}, {b})"

    flat = re.sub(r"\s+", " ", value).strip()
    return re.sub(r"#([0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3,4})\b", one, flat)


def extract(source: str, path: str) -> dict[str, list[dict]]:
    """variables, classes, keyframes and import sources. Classes count once for a file."""
    text = _COMMENT.sub(_blank, source)
    line = lambda at: text.count("\n", 0, at) + 1
    variables, classes, keyframes = [], {}, []
    module = int(path.endswith(".module.css"))
    stack: list[str] = []
    start = i = 0
    quote = ""
    while i < len(text):
        c = text[i]
        if quote:
            i += 1 + (c == "\\")
            quote = "" if c == quote else quote
            continue
        if c in "\"'":
            quote = c
        elif c == "{":
            head = text[start:i].strip()
            if m := re.match(r"@(?:-\w+-)?keyframes\s+[\"']?([\w-]+)", head):
                keyframes.append({"name": m[1], "line_number": line(start + len(text[start:i]) - len(text[start:i].lstrip()))})
            elif not head.startswith("@") and not any("keyframes" in s for s in stack):
                for m in re.finditer(r"\.(-?[A-Za-z_][\w-]*)", re.sub(r"\[[^\]]*\]|\"[^\"]*\"", "", head)):
                    at = text.find("." + m[1], start)
                    classes.setdefault(m[1], {"name": m[1], "is_module": module, "line_number": line(max(at, start))})
            stack.append(head)
            start = i + 1
        elif c in ";}":
            part = text[start:i]
            if m := re.match(r"\s*(?P<name>--[\w-]+)\s*:(.*)$", part, re.S):
                theme = any(s.startswith("@theme") for s in stack)
                variables.append({"name": m[1], "value": colour(m[2]) or None, "scope": "@theme" if theme else ":root", "line_number": line(start + m.start(1))})
            if c == "}" and stack:
                stack.pop()
            start = i + 1
        i += 1
    return {"css_variables": variables, "css_classes": list(classes.values()), "css_keyframes": keyframes, "sources": [m[1] for m in _IMPORT.finditer(text)]}
