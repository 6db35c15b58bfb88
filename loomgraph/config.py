"""Configuration of an index: what to read, and the rules of the project."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

_ENDINGS = {
    "css": "css", "javascript": "cjs js mjs", "json": "json", "jsx": "jsx", "markdown": "md", "mdc": "mdc", "mdx": "mdx", "shell": "sh", "text": "txt", "tsx": "tsx",
    "typescript": "cts mts ts", "yaml": "yaml yml",
}
LANGUAGES = {f".{e}": language for language, endings in _ENDINGS.items() for e in endings.split()}
CODE = tuple(e for e, language in LANGUAGES.items() if language in ("javascript", "jsx", "tsx", "typescript"))
INCLUDE = tuple(f"**/*{e}" for e in LANGUAGES if e != ".txt")
#: Folders of other programs' output and copies; a compatible default, in alphabetical order.
EXCLUDE = (".cache", ".git", ".next", ".output", ".parcel-cache", ".turbo", "build", "coverage", "dist", "node_modules", "storybook-static", "vendor")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Boundary:
    name: str
    from_glob: str
    to_glob: str
    action: str = "deny"

    def __post_init__(self) -> None:
        if self.action not in ("deny", "allow"):
            raise ConfigError(f"boundary {self.name}: action is deny or allow, not {self.action!r}")


@dataclass(frozen=True)
class Config:
    root: str
    index_path: str | None = None
    include: tuple[str, ...] = INCLUDE
    exclude_dir_names: tuple[str, ...] = EXCLUDE
    tsconfig_path: str | None = None
    text_search: bool = False
    recipe_recency: bool = True
    boundaries: tuple[Boundary, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [b.name for b in self.boundaries]
        if len(set(names)) < len(names):
            raise ConfigError("two boundaries have one name")

    @property
    def index(self) -> str:
        return self.index_path or f"{self.root.rstrip('/')}/.loomgraph"

    @property
    def own_folder(self) -> str | None:
        """The folder of the index below the root, if that's where it is."""
        root = self.root.rstrip("/") + "/"
        return self.index.rstrip("/").removeprefix(root) if self.index.startswith(root) else None

    @classmethod
    def load(cls, root: str, path: str | None = None, **overrides) -> Config:
        """From a JSON file (loomgraph.config.json in the root if there is one); unknown keys are errors."""
        found = Path(path) if path else Path(root) / "loomgraph.config.json"
        given = json.loads(found.read_text()) if found.exists() else {}
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(given) - known):
            raise ConfigError(f"unknown keys: {', '.join(unknown)}")
        given = {"root": root} | given | {k: v for k, v in overrides.items() if v is not None}
        try:
            given["boundaries"] = tuple(b if isinstance(b, Boundary) else Boundary(**b) for b in given.get("boundaries", ()))
        except TypeError as e:
            raise ConfigError(str(e)) from e
        for k in ("include", "exclude_dir_names"):
            if k in given:
                given[k] = tuple(given[k])
        return cls(**given)
