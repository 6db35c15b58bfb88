"""What git knows of a source tree: changes since a commit, and past states of it."""

from __future__ import annotations

import os
import shutil
import subprocess
from pathlib import Path


class GitError(RuntimeError):
    pass


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def head(root: str) -> str | None:
    try:
        return _git(root, "rev-parse", "HEAD").strip()
    except (GitError, FileNotFoundError):
        return None


def is_ancestor(root: str, commit: str) -> bool:
    try:
        _git(root, "merge-base", "--is-ancestor", commit, "HEAD")
    except GitError:
        return False
    return True


def _status(root: str) -> set[str]:
    entries = _git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0")
    out, i = set(), 0
    while i < len(entries):
        e = entries[i]
        if len(e) > 3:
            out.add(e[3:])
            if e[0] in "RC":  # the old name follows
                i += 1
                out.add(entries[i])
        i += 1
    return out


def changed_files(root: str, ref: str) -> set[str]:
    """Paths that differ between ref and the working tree: committed since, staged, edited or new."""
    try:
        _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}")
    except GitError as e:
        raise GitError(f"{ref!r} names no commit") from e
    return {p for p in _git(root, "diff", "--name-only", "-z", f"{ref}...HEAD").split("\0") if p} | _status(root)


KEEP, KEEP_BYTES = 5, 500 << 20


def snapshot(root: str, ref: str, cache: str) -> tuple[str, str]:
    """(commit, folder) with the tree of a commit, kept in the cache; the least used leave it first."""
    commit = _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").strip()
    folder = Path(cache) / commit
    if not (folder / ".done").exists():
        shutil.rmtree(folder, ignore_errors=True)
        folder.mkdir(parents=True)
        packed = subprocess.Popen(["git", "-C", root, "archive", commit], stdout=subprocess.PIPE)
        done = subprocess.run(["tar", "-x", "-C", str(folder)], stdin=packed.stdout)
        if packed.wait() or done.returncode:
            shutil.rmtree(folder)
            raise GitError(f"{ref!r} can't be unpacked")
        (folder / ".done").touch()
    os.utime(folder)
    _trim(Path(cache), folder)
    return commit, str(folder)


def _trim(cache: Path, keep: Path) -> None:
    entries = sorted((d for d in cache.iterdir() if d.is_dir()), key=lambda d: -d.stat().st_mtime)
    size = 0
    for n, d in enumerate(entries):
        size += sum(f.stat().st_size for f in d.rglob("*") if f.is_file())
        if d != keep and (n >= KEEP or size > KEEP_BYTES):
            shutil.rmtree(d, ignore_errors=True)
