"""The scan of a source tree: which files there are, and their facts as typed tables."""

from __future__ import annotations

import hashlib
import os
import re
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.config import LANGUAGES, Config
from loomgraph.functions.words import stem, tokens
from loomgraph.schema import SCHEMAS
from loomgraph.session import ship, spread
from loomgraph.sources.extract import adapters


def pattern_of(glob: str) -> str:
    """A path glob as a regular expression: ** crosses folders, * doesn't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            stop = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : stop].split(","))) + ")", stop + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def list_files(config: Config) -> list[str]:
    """Paths below the root that the globs include, hidden ones too, less those in excluded folders; sorted.

    Of the index's own folder only the recipes count.
    """
    wanted = re.compile("|".join(pattern_of(g) for g in config.include))
    own = config.own_folder
    found, banned = [], set(config.exclude_dir_names)
    for folder, names, files in os.walk(config.root):
        names[:] = [n for n in names if n not in banned]
        at = os.path.relpath(folder, config.root).replace(os.sep, "/")
        if at == own:
            names[:] = [n for n in names if n == "recipes"]
            continue
        found += [p for f in files if wanted.match(p := f if at == "." else f"{at}/{f}")]
    return sorted(found)


_FACTS = ("symbols", "imports", "exports", "components", "calls", "type_members", "markers", "suppressions", "css_variables", "css_classes", "css_keyframes")


def facts_of(path: str, text: str, extra_text: bool = False, by_ending: dict | None = None) -> tuple[dict[str, list[dict]], str | None]:
    """Rows of each table for one file, and what kept it from being read, if anything."""
    found, problem = adapters.extract(path, text, adapters.chosen() if by_ending is None else by_ending)
    out: dict[str, list[dict]] = {k: [] for k in _FACTS} | {k: v for k, v in found.items() if k in _FACTS}
    if extra_text:
        out["source_fts"] = [{"token": stem(w), "pos": i} for i, w in enumerate(tokens(text))]
    return out, problem


def _row_type(name: str) -> T.StructType:
    return T.StructType([f for f in SCHEMAS[name].fields if f.name not in ("id", "file_path")])


def parsed_schema(text_search: bool) -> T.StructType:
    s = T.StructType([f for f in SCHEMAS["files"].fields]).add("problem", "string").add("parse_ms", "double")
    for name in (*_FACTS, *(["source_fts"] if text_search else [])):
        s = s.add(name, T.ArrayType(_row_type(name)))
    return s


class _Rows:
    """Makes the row of a file; goes to the executors."""

    def __init__(self, schema: T.StructType, text_search: bool, now: int):
        self.names, self.text_search, self.now, self.by_ending = schema.names, text_search, now, adapters.chosen()
        self.fields = {f.name: f.dataType.elementType.names for f in schema.fields if isinstance(f.dataType, T.ArrayType)}

    def row(self, path: str, text: str, size: int, modified: int, began: float) -> dict:
        facts, problem = facts_of(path, text, self.text_search, self.by_ending)
        row = {
            "path": path, "content_hash": hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), "size": size, "line_count": text.count("\n") + 1,
            "language": LANGUAGES.get(os.path.splitext(path)[1].lower(), "text"), "last_modified": modified, "indexed_at": self.now,
            "problem": problem, "parse_ms": (time.perf_counter() - began) * 1000,
        }
        return row | {n: [{f: x.get(f) for f in fields} for x in facts.get(n, [])] for n, fields in self.fields.items()}


def parse(spark: SparkSession, config: Config, paths: Iterable[str], now: int | None = None) -> DataFrame:
    """One row for each readable file, with arrays of facts. Files are read where they are parsed."""
    ship(spark)
    root, schema = config.root, parsed_schema(config.text_search)
    make = _Rows(schema, config.text_search, int(time.time() * 1000) if now is None else now)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                began = time.perf_counter()
                try:
                    file = Path(root) / path
                    data, stat = file.read_bytes(), file.stat()
                except OSError:
                    continue
                rows.append(make.row(path, data.decode("utf-8", "replace"), stat.st_size, int(stat.st_mtime * 1000), began))
            yield pd.DataFrame(rows, columns=make.names)

    listed = list(paths)
    frame = spark.createDataFrame([(p,) for p in listed], "path string")
    return frame.repartition(max(1, min(len(listed) // 8, 4 * spark.sparkContext.defaultParallelism)), "path").mapInPandas(run, schema)


def tree(spark: SparkSession, config: Config) -> DataFrame:
    """(path, content, modified) of the included files of a tree on any filesystem that executors reach; nothing is listed here.

    Spark's file sources pass over hidden files and folders, so those are left out.
    """
    root = config.root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = root.split("://", 1)[-1] if "://" in root else root.removeprefix("file:")
    path = F.regexp_extract("path", "^[A-Za-z0-9+.-]*:/*(?=/)|^", 0)  # the scheme
    inside = F.substring(F.expr("substring(path, length(__scheme) + 1)"), len(bare) + 2, 1 << 30) if "://" not in root else F.substring("path", len(root) + 2, 1 << 30)
    files = found.withColumn("__scheme", path).select(inside.alias("path"), "content", F.unix_millis("modificationTime").alias("modified"))
    wanted = F.lit(False)
    for g in config.include:
        wanted = wanted | F.col("path").rlike(pattern_of(g))
    banned = F.arrays_overlap(F.slice(F.reverse(F.split("path", "/")), 2, 1 << 20), F.array(*[F.lit(x) for x in config.exclude_dir_names])) if config.exclude_dir_names else F.lit(False)
    own = config.own_folder
    inner = F.col("path").startswith(f"{own}/") & ~F.col("path").startswith(f"{own}/recipes/") if own else F.lit(False)
    return files.where(wanted & ~banned & ~inner)


def parse_tree(spark: SparkSession, config: Config, now: int | None = None) -> DataFrame:
    """As parse(), for all files of tree()."""
    return parse_texts(tree(spark, config), config.text_search, now)


def parse_texts(files: DataFrame, text_search: bool = False, now: int | None = None, tables: tuple[str, ...] | None = None) -> DataFrame:
    """As parse(), for files whose bytes are at hand: (path, content, modified). tables: those wanted, if not all.

    A source of small files in few pieces, as a table in one file, would be parsed by as few tasks, so files
    are spread by path first; that costs little beside the parser.
    """
    ship(files.sparkSession)
    schema = parsed_schema(text_search)
    if tables is not None:
        schema = T.StructType([f for f in schema.fields if not isinstance(f.dataType, T.ArrayType) or f.name in tables])
    make = _Rows(schema, text_search, int(time.time() * 1000) if now is None else now)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [make.row(p, bytes(c).decode("utf-8", "replace"), len(c), int(m), time.perf_counter()) for p, c, m in zip(part["path"], part["content"], part["modified"])]
            yield pd.DataFrame(rows, columns=make.names)

    return spread(files.select("path", "content", "modified"), "path").mapInPandas(run, schema)


def explode_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The typed tables of parsed files; ids come from the path and the place in the file, and survive rebuilds."""
    out = {"files": parsed.select(*SCHEMAS["files"].names)}
    for name in parsed.columns:
        if name not in SCHEMAS or name == "files":
            continue
        rows = parsed.select(F.col("path").alias("file_path"), F.posexplode(name).alias("n", "r"))
        columns = []
        for c in SCHEMAS[name].names:
            if c == "id":
                columns.append(F.xxhash64(F.lit(name), "file_path", "n").alias("id"))
            else:
                columns.append(F.col("file_path") if c == "file_path" else F.col(f"r.{c}"))
        out[name] = rows.select(*columns)
    return out


def hashes_on_disk(spark: SparkSession, config: Config, paths: DataFrame, texts: bool = False) -> DataFrame:
    """(path, content_hash) of the files that can be read now, with texts also value. paths: (path)."""
    root = config.root
    names = ["path", "content_hash", *(["value"] if texts else [])]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path in part["path"]:
                try:
                    text = (Path(root) / path).read_bytes().decode("utf-8", "replace")
                except OSError:
                    continue
                rows.append((path, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), text)[: len(names)])
            yield pd.DataFrame(rows, columns=names)

    ship(spark)
    return paths.select("path").mapInPandas(run, ", ".join(f"{n} string" for n in names))
