"""Keeping an index fresh: file events, joined into bursts, each followed by a targeted rebuild."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from loomgraph.config import CODE

WATCHED = (*CODE, ".css")
QUIET_MS, SETTLE_MS = 250, 200


def debounce(events: DataFrame, ts: str, gap: str, *keys: str, path: str | None = None) -> DataFrame:
    """Events joined as long as each follows the last within the gap: (keys, window, began, last, events, paths).

    In a stream the input needs a watermark on ts.
    """
    wanted = [F.min(ts).alias("began"), F.max(ts).alias("last"), F.count("*").alias("events")]
    if path:
        wanted.append(F.sort_array(F.collect_set(path)).alias("paths"))
    return events.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*wanted)


def is_watched(path: str, excluded: Iterable[str], recipes: str = ".loomgraph/recipes") -> bool:
    """Code and style files outside of excluded folders, and the project's recipes."""
    if path.startswith(recipes.rstrip("/") + "/") and path.endswith((".sql", ".md")):
        return True
    return not set(path.split("/")[:-1]) & set(excluded) and os.path.splitext(path)[1].lower() in WATCHED


def listing(root: str, excluded: Iterable[str]) -> dict[str, tuple[int, int]]:
    """(mtime, size) of each watched file."""
    out, banned = {}, set(excluded)
    for folder, names, files in os.walk(root):
        names[:] = [n for n in names if n not in banned]
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        for f in files:
            p = f if at == "." else f"{at}/{f}"
            if is_watched(p, banned):
                try:
                    s = os.stat(os.path.join(folder, f))
                except OSError:
                    continue
                out[p] = (s.st_mtime_ns, s.st_size)
    return out


def compare(before: dict, after: dict) -> list[tuple[str, str]]:
    """(path, event) of what was added, changed or unlinked."""
    out = [(p, "add" if p not in before else "change") for p, v in after.items() if before.get(p) != v]
    return sorted(out + [(p, "unlink") for p in before if p not in after])


class _Reader(SimpleDataSourceStreamReader):
    """Offsets hold the listing's changes so far: each batch is what differs from the listing before."""

    def __init__(self, root: str, excluded: list[str]):
        self.root, self.excluded = root, excluded
        self.seen = listing(root, excluded)
        self.log: list[tuple[str, str, int]] = []

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict):
        now = listing(self.root, self.excluded)
        stamp = int(time.time() * 1000)
        settled = {p: v for p, v in now.items() if self.seen.get(p) == v or stamp - v[0] // 1_000_000 >= SETTLE_MS}
        waiting = {p: self.seen[p] for p in now if p not in settled and p in self.seen}
        found = compare(self.seen, settled | waiting)
        self.seen = settled | waiting
        self.log += [(p, e, stamp) for p, e in found]
        rows = self.log[start["n"] :]
        return iter(rows), {"n": len(self.log)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self.log[start["n"] : end["n"]])

    def commit(self, end: dict) -> None:
        pass


class FileEvents(DataSource):
    """The streaming source `file_events`: path, event and time (epoch ms) of changes below option root."""

    @classmethod
    def name(cls) -> str:
        return "file_events"

    def schema(self) -> str:
        return "path string, event string, at bigint"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["root"], [x for x in self.options.get("excluded", "").split(",") if x])


def events(spark: SparkSession, root: str, excluded: Iterable[str] = ()) -> DataFrame:
    """A stream of file events."""
    spark.dataSource.register(FileEvents)
    return spark.readStream.format("file_events").option("root", root).option("excluded", ",".join(excluded)).load()


class Watcher:
    """Rebuilds an index as its files change: events come in bursts, and one rebuild runs at a time.

    A poller on the driver stands in for the file events of an operating system; what it finds is
    held back until it has been quiet for a while. Errors of a rebuild are reported and the watch
    goes on. `active` is set once the first rebuild has made the index current.
    """

    def __init__(self, index, on_error: Callable[[Exception], None] = lambda e: None, quiet_ms: int = QUIET_MS, poll_ms: int = 50):
        self.index, self.on_error, self.quiet, self.poll = index, on_error, quiet_ms / 1000, poll_ms / 1000
        self.active = False
        self.batches: list[list[str]] = []
        self._stop = threading.Event()
        self._thread: threading.Thread | None = None

    def start(self, prime: bool = True) -> None:
        self.seen = listing(self.index.config.root, self.index.config.exclude_dir_names)
        if prime:
            self._rebuild(None)
        self.active = True
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _rebuild(self, paths: list[str] | None) -> None:
        try:
            self.index.build("incremental") if paths is None else self.index.build("files", paths)
        except Exception as e:
            self.on_error(e)

    def _loop(self) -> None:
        pending: set[str] = set()
        last = time.monotonic()
        while not self._stop.wait(self.poll):
            now = listing(self.index.config.root, self.index.config.exclude_dir_names)
            if found := compare(self.seen, now):
                self.seen, last = now, time.monotonic()
                pending |= {p for p, _ in found}
            if pending and time.monotonic() - last >= self.quiet:
                self._flush(pending)
        if pending:
            self._flush(pending)

    def _flush(self, pending: set[str]) -> None:
        paths = sorted(p for p in pending if os.path.splitext(p)[1].lower() in WATCHED)
        pending.clear()
        if paths:
            self.batches.append(paths)
            self._rebuild(paths)

    def stop(self) -> None:
        """End the watch after what is under way and what waits."""
        self._stop.set()
        if self._thread:
            self._thread.join()
        self.active = False


def follow(spark: SparkSession, index, checkpoint: str):
    """The same as a streaming query: each micro-batch of file events is one targeted rebuild."""

    def rebuild(batch: DataFrame, n: int) -> None:
        paths = sorted(r[0] for r in batch.select("path").distinct().collect())
        if paths:
            index.build("files", paths)

    stream = events(spark, index.config.root, index.config.exclude_dir_names)
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).start()
