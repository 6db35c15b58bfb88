"""Which extractor reads which files. A project may add its own, or put one in place of those here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from loomgraph.config import CODE
from loomgraph.sources import text_facts
from loomgraph.sources.extract import css, tsjs
from loomgraph.sources.extract.lexer import SyntaxProblem

#: Rows by table, and what kept the file from being read, if anything.
Facts = tuple[dict[str, list[dict]], str | None]


@dataclass(frozen=True)
class Adapter:
    """An extractor for the files with certain endings: (path, text) to rows by table, without file_path and id."""

    id: str
    extensions: tuple[str, ...]
    extract: Callable[[str, str], Facts]


def _code(path: str, text: str) -> Facts:
    ending = "." + path.rpartition(".")[2].lower()
    try:
        return tsjs.extract(text, ending) | {"markers": text_facts.find_markers(text), "suppressions": text_facts.find_suppressions(text)}, None
    except SyntaxProblem as e:
        return {}, str(e)


def _style(path: str, text: str) -> Facts:
    own = css.extract(text, path)
    imports = [{"source": s, "resolved_path": None, "specifiers": "[]", "is_type_only": 0, "line_number": 0} for s in own.pop("sources")]
    return own | {"imports": imports} | _text(path, text)[0], None


def _text(path: str, text: str) -> Facts:
    return {"markers": text_facts.find_markers(text), "suppressions": text_facts.find_suppressions(text)}, None


BUILT_IN = (Adapter("code", CODE, _code), Adapter("style", (".css",), _style))
_added: list[Adapter] = []


def register(adapter: Adapter) -> None:
    """Add an adapter; it wins over earlier ones for its endings. One of the same id is replaced."""
    if not adapter.id or not all(e.startswith(".") and e == e.lower() for e in adapter.extensions):
        raise ValueError("an adapter has an id, and endings in lower case with their dots")
    _added[:] = [a for a in _added if a.id != adapter.id]
    _added.append(adapter)


def unregister(id: str) -> None:
    _added[:] = [a for a in _added if a.id != id]


def chosen() -> dict[str, Callable[[str, str], Facts]]:
    """The extractor of each ending, as it goes to the executors; other files are text."""
    return {e: a.extract for a in (*BUILT_IN, *_added) for e in a.extensions}


def extract(path: str, text: str, by_ending: dict[str, Callable[[str, str], Facts]]) -> Facts:
    return by_ending.get("." + path.rpartition(".")[2].lower() if "." in path else "", _text)(path, text)
