"""Globs as regular expressions, of the two kinds that rules are written in."""

from __future__ import annotations

import re
from dataclasses import dataclass


def glob_to_regex(glob: str) -> str:
    """A whole-string pattern for a glob whose * and ? match any character, / too; [^...] negates."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            j = i + 1
            if j < len(glob) and glob[j] == "^":
                j += 1
            if j < len(glob) and glob[j] == "]":  # a bracket that comes first stands for itself
                j += 1
            while j < len(glob) and glob[j] != "]":
                j += 1
            if j >= len(glob):
                return "(?!)"  # an open set matches nothing
            body = glob[i + 1 : j]
            negated = body.startswith("^")
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def literal_prefix(glob: str) -> str:
    """What every match of the glob starts with."""
    return re.split(r"[*?\[]", glob, maxsplit=1)[0]


def owner_glob_to_regex(pattern: str) -> str:
    """A pattern of an owners file: * stays within a segment, ** crosses; a leading / anchors, a trailing one takes all below."""
    anchored, below = pattern.startswith("/"), pattern.endswith("/")
    body = pattern.removeprefix("/").removesuffix("/")
    out, i = [], 0
    while i < len(body):
        if body.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif body.startswith("/**", i):
            out.append("(?:/.*)?")
            i += 3
        elif body.startswith("**", i):
            out.append(".*")
            i += 2
        elif body[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(re.escape(body[i]))
            i += 1
    return ("^" if anchored else "(?:^|.*/)") + "".join(out) + ("(?:/.*)?$" if below else "$")


@dataclass(frozen=True)
class OwnerRule:
    index: int
    pattern: str
    regex: str
    owners: tuple[str, ...]


def parse_owners(text: str) -> list[OwnerRule]:
    """Rules in file order; lines without an owner don't count."""
    rules = []
    for line in text.split("\n"):
        pattern, *owners = re.sub(r"#.*$", "", line).split() or [""]
        if pattern and owners:
            rules.append(OwnerRule(len(rules), pattern, owner_glob_to_regex(pattern), tuple(owners)))
    return rules
