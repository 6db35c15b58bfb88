"""The index on disk: immutable snapshots of Parquet tables, and a pointer to the one that holds."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import Config
from loomgraph.operators.lookup import COUNTED, table_stats
from loomgraph.schema import BY_FILE, SCHEMA_VERSION, SCHEMAS, USER_TABLES, Tables
from loomgraph.sources import git, resolve, scan

RECENT_DAYS = 90


@dataclass
class IndexResult:
    mode: str
    indexed: int
    skipped: int
    elapsed_ms: int
    stats: dict
    slowest: list[dict] | None = None


class Index:
    """The tables of one project. Every write makes a new snapshot and then moves the pointer."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.path = spark, config, Path(config.index)

    # Reading

    def _pointer(self) -> dict[str, str]:
        try:
            return json.loads((self.path / "current.json").read_text())
        except OSError:
            return {}

    def tables(self) -> Tables:
        given = {}
        for name, folder in self._pointer().items():
            if name in SCHEMAS:
                given[name] = self.spark.read.schema(SCHEMAS[name]).parquet(str(self.path / folder))
        return Tables(self.spark, given)

    def meta(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.tables().meta.collect()}

    # Writing

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Replace tables, several at a time. Files with one path stay together, sorted, so that scans can skip row groups."""
        pointer, stamp = self._pointer(), f"{time.time_ns()}-{uuid.uuid4().hex[:6]}"

        def write(name: str) -> None:
            key = BY_FILE.get(name)
            out = tables[name].select(*[F.col(c).cast(SCHEMAS[name][c].dataType) for c in SCHEMAS[name].names])
            if key:
                out = out.repartitionByRange(key).sortWithinPartitions(key)
            out.write.parquet(str(self.path / f"data/{name}/{stamp}"))

        with ThreadPoolExecutor(max_workers=8) as pool:
            list(pool.map(write, tables))
        old = [pointer[name] for name in tables if name in pointer]
        pointer |= {name: f"data/{name}/{stamp}" for name in tables}
        self._move(pointer)
        for folder in old:
            shutil.rmtree(self.path / folder, ignore_errors=True)

    def _move(self, pointer: dict[str, str]) -> None:
        self.path.mkdir(parents=True, exist_ok=True)
        new = self.path / f"current.{uuid.uuid4().hex[:6]}"
        new.write_text(json.dumps(pointer))
        os.replace(new, self.path / "current.json")

    def _meta_rows(self, values: dict[str, object]) -> DataFrame:
        rows = [(k, None if v is None else str(v)) for k, v in values.items()]
        return self.spark.createDataFrame(rows, SCHEMAS["meta"])

    # Building

    def build(self, mode: str = "incremental", files: Iterable[str] | None = None, performance: bool = False) -> IndexResult:
        """full, incremental (by git and hashes) or files (those named). A stale schema or another text setting makes it full."""
        began = time.time()
        pointer, meta = self._pointer(), {}
        if pointer.get("meta"):
            meta = self.meta()
        fresh = not pointer.get("files") or meta.get("schema_version") != str(SCHEMA_VERSION) or meta.get("text_search") != str(int(self.config.text_search))
        if files is not None:
            mode = "files"
        listed = scan.list_files(self.config)
        targets, gone = listed, []
        if not fresh and mode == "incremental":
            commit = meta.get("last_indexed_commit")
            now = git.head(self.config.root)
            if commit and now and git.is_ancestor(self.config.root, commit):
                targets, gone = self._touched(listed, git.changed_files(self.config.root, commit))
            else:
                fresh = True
        elif not fresh and mode == "files":
            wanted = list(files or ())
            targets = [p for p in wanted if (Path(self.config.root) / p).is_file()]
            gone = sorted(set(wanted) - set(targets))
        elif mode == "full" or fresh:
            fresh = True
        mode = "full" if fresh else mode
        if not fresh and not self._boundaries_hold():
            self.reconcile_boundaries()
        if not fresh and not targets and not gone:
            return IndexResult(mode, 0, 0, int((time.time() - began) * 1000), self.stats())
        parsed = scan.parse(self.spark, self.config, targets).cache()
        changed, skipped = parsed, 0
        kept: Tables | None = None
        if not fresh:
            kept = self.tables()
            changed = parsed.join(kept.files.select("path", "content_hash"), ["path", "content_hash"], "left_anti").cache()
            skipped = parsed.count() - changed.count()
            wanted = self.spark.createDataFrame([(p,) for p in targets], "path string")
            unreadable = [r[0] for r in wanted.join(parsed.select("path"), "path", "left_anti").collect()]
            gone = sorted(set(gone) | set(unreadable))
        indexed = changed.count()
        if not fresh and not indexed and not gone:
            result = IndexResult(mode, 0, skipped, int((time.time() - began) * 1000), self.stats())
            parsed.unpersist()
            return result
        new = scan.explode_tables(changed)
        files_now = new["files"]
        if kept is not None:
            dropped = changed.select("path").union(self.spark.createDataFrame([(p,) for p in gone], "path string")).distinct()
            files_now = kept.files.join(dropped, "path", "left_anti").unionByName(new["files"])
        resolved = resolve.resolve(new["imports"], files_now, resolve.aliases(self.config.root, self.config.tsconfig_path))
        new["imports"] = resolved
        new["dependencies"] = resolve.dependencies(resolved)
        if kept is not None:
            for name in list(new):
                key = BY_FILE[name]
                rest = kept[name].join(dropped.withColumnRenamed("path", key), key, "left_anti")
                new[name] = rest.unionByName(new[name])
        new["boundary_rules"] = self._boundaries()
        if fresh:
            user = {n: self._pointer()[n] for n in USER_TABLES if n in self._pointer()}
            self._move(self._pointer() | user)
        self.write(new)
        count = self.tables().files.count()
        stamp = {"schema_version": SCHEMA_VERSION, "text_search": int(self.config.text_search), "last_indexed_commit": git.head(self.config.root), "indexed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "file_count": count, "project_root": self.config.root}
        coverage_keys = {k: v for k, v in meta.items() if k.startswith("coverage_") and not fresh}
        self.write({"meta": self._meta_rows(stamp | coverage_keys)})  # last: a crash before leaves the old stamp
        slow = None
        if performance:
            slow = [r.asDict() for r in parsed.select("path", "parse_ms").orderBy(F.desc("parse_ms")).limit(10).collect()]
        parsed.unpersist()
        changed.unpersist()
        return IndexResult(mode, indexed, skipped, int((time.time() - began) * 1000), self.stats(), slow)

    def stats(self) -> dict:
        return table_stats(self.tables(), COUNTED).first().asDict()

    def _touched(self, listed: list[str], changed: set[str]) -> tuple[list[str], list[str]]:
        """Paths to read again and paths that are gone: those that changed, appeared or left since the last run."""
        make = lambda paths: self.spark.createDataFrame([(p,) for p in paths], "path string")
        known = self.tables().files.select("path", F.lit(True).alias("known"))
        wide = make(listed).withColumn("there", F.lit(True)).join(known, "path", "full").join(make(changed).withColumn("changed", F.lit(True)), "path", "full")
        read = F.coalesce("there", F.lit(False)) & (F.col("known").isNull() | F.col("changed"))
        rows = wide.where(read | (F.col("known") & F.col("there").isNull())).select("path", "there").collect()  # the files of this one run
        return sorted(r["path"] for r in rows if r["there"]), sorted(r["path"] for r in rows if not r["there"])

    def _boundaries(self) -> DataFrame:
        return self.spark.createDataFrame([(b.name, b.from_glob, b.to_glob, b.action) for b in self.config.boundaries], SCHEMAS["boundary_rules"])

    def _boundaries_hold(self) -> bool:
        stored = {tuple(r) for r in self.tables().boundary_rules.collect()}
        return stored == {(b.name, b.from_glob, b.to_glob, b.action) for b in self.config.boundaries}

    def reconcile_boundaries(self) -> None:
        """Rules follow the configuration on every run, whether or not files changed."""
        self.write({"boundary_rules": self._boundaries()})

    # Coverage

    def ingest_coverage(self, path: str, kind: str | None = None) -> dict:
        from loomgraph.operators import coverage
        from loomgraph.sources import coverage_files

        rows, kind = coverage_files.read(self.spark, path, kind)
        done = coverage.upsert(self.tables(), rows, os.path.abspath(self.config.root), kind)
        found = {"ingested": {"symbols": done.symbols, "files": done.files}, "skipped": {"unmatched_files": done.unmatched_files, "statements_no_symbol": done.statements_no_symbol}, "pruned_orphans": done.pruned_orphans, "format": kind}
        meta = self.meta() | {"coverage_last_ingested_at": int(time.time() * 1000), "coverage_last_ingested_path": path, "coverage_last_ingested_format": kind}
        self.write({"coverage": done.coverage, "meta": self._meta_rows(meta)})
        return found

    # Baselines: a folder of rows and a manifest each

    def _baseline(self, name: str) -> Path:
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError(f"{name!r} can't name a baseline")
        return self.path / "baselines" / name

    def save_baseline(self, name: str, rows: DataFrame, sql: str, recipe_id: str | None = None) -> dict:
        folder = self._baseline(name)
        part = folder.with_name(f".{name}-{uuid.uuid4().hex[:6]}")
        rows.write.parquet(str(part / "rows"))
        manifest = {"name": name, "recipe_id": recipe_id, "sql": sql, "row_count": self.spark.read.parquet(str(part / "rows")).count(), "git_ref": git.head(self.config.root), "created_at": int(time.time() * 1000)}
        (part / "manifest.json").write_text(json.dumps(manifest))
        shutil.rmtree(folder, ignore_errors=True)
        os.replace(part, folder)
        return manifest

    def baseline(self, name: str) -> tuple[dict, DataFrame] | None:
        folder = self._baseline(name)
        if not (folder / "manifest.json").exists():
            return None
        return json.loads((folder / "manifest.json").read_text()), self.spark.read.parquet(str(folder / "rows"))

    def baselines(self) -> list[dict]:
        """The newest first."""
        found = [json.loads(p.read_text()) for p in (self.path / "baselines").glob("[!.]*/manifest.json")]
        return sorted(sorted(found, key=lambda m: m["name"]), key=lambda m: -m["created_at"])

    def drop_baseline(self, name: str) -> bool:
        folder = self._baseline(name)
        there = folder.exists()
        shutil.rmtree(folder, ignore_errors=True)
        return there

    # Recency of recipes: a small file of user data

    def recency(self) -> dict[str, dict]:
        try:
            return json.loads((self.path / "recency.json").read_text())
        except (OSError, ValueError):
            return {}

    def touch_recipe(self, recipe_id: str, now: int | None = None) -> None:
        """Count a successful run; entries older than RECENT_DAYS go. A failure here never fails the query."""
        if not self.config.recipe_recency:
            return
        now = int(time.time() * 1000) if now is None else now
        try:
            kept = {k: v for k, v in self.recency().items() if v["last_run_at"] >= now - RECENT_DAYS * 86_400_000}
            kept[recipe_id] = {"last_run_at": now, "run_count": kept.get(recipe_id, {}).get("run_count", 0) + 1}
            self.path.mkdir(parents=True, exist_ok=True)
            new = self.path / f"recency.{uuid.uuid4().hex[:6]}"
            new.write_text(json.dumps(kept))
            os.replace(new, self.path / "recency.json")
        except OSError:
            pass


def as_dict(result: IndexResult) -> dict:
    return {k: v for k, v in asdict(result).items() if v is not None}
