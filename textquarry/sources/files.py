"""Source trees: reading them, writing them back, and the log of what was done."""

from __future__ import annotations

import fnmatch
import os
import shutil
import tempfile
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .corpus import Corpus

MAX_FILE_BYTES = 1 << 20


def _relative(root: str) -> F.Column:
    clean = os.path.abspath(root).rstrip("/") + "/"
    return F.replace(F.substring_index("path", clean, -1), F.lit("\\"), F.lit("/"))


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, text, lang of a tree: no hidden or build directories, no large, binary or
    undecodable files, and none that the tree's .gitignore files leave out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = raw.filter(F.col("length") <= max_bytes).withColumn("path", _relative(root))
    raw = raw.filter(~paths.in_skipped_dir(F.col("path")) & ~F.element_at(F.split("path", "/"), -1).startswith("."))
    for pattern in ignored(root):
        raw = raw.filter(~F.col("path").rlike(pattern))
    text = F.col("content").cast("string")
    ok = (F.locate("\0", text) == 0) & F.is_valid_utf8(text)
    return raw.filter(ok).select("path", text.alias("text"), paths.language(F.col("path"), text).alias("lang"))


def skipped_large(spark: SparkSession, root: str, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, length of the files that scan() leaves out for their size; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    return raw.filter(F.col("length") > max_bytes).select(_relative(root).alias("path"), "length").filter(~paths.in_skipped_dir(F.col("path")))


def ignored(root: str) -> list[str]:
    """Patterns of all .gitignore files of a tree, as regular expressions over its relative paths."""
    out = []
    for file in sorted(Path(root).rglob(".gitignore")):
        base = file.parent.relative_to(root).as_posix()
        base = "" if base == "." else f"{base}/"
        for line in file.read_text(errors="replace").splitlines():
            line = line.strip()
            if not line or line.startswith(("#", "!")):
                continue
            anchored, folder = "/" in line.rstrip("/"), line.endswith("/")
            body = fnmatch.translate(line.strip("/")).removeprefix("(?s:").rsplit(")", 1)[0].replace(".*", "[^/]*")
            out.append(f"^{base}{'' if anchored else '(?:.*/)?'}{body}{'/' if folder else '(?:/|$)'}")
    return out


def is_crlf(text: F.Column) -> F.Column:
    """Whether most lines of a text end in a carriage return."""
    return F.regexp_count(text, F.lit("\r\n")) * 2 > F.regexp_count(text, F.lit("\n"))


def with_line_ends(new: F.Column, old: F.Column) -> F.Column:
    """new with the line ends that old has."""
    plain = F.replace(new, F.lit("\r\n"), F.lit("\n"))
    return F.when(is_crlf(old), F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)


def from_dir(spark: SparkSession, root: str) -> Corpus:
    from ..operators.parse import code_symbols

    files = scan(spark, root)
    return Corpus(files, code_symbols(files))


class Sandbox:
    """Where writes may go: below the root, not through links, not to guarded places."""

    # Fixed values.
    GUARDED = (".git", ".github", ".hooks", ".claude")
    GUARDED_FILES = ("mcp.json", ".mcp.json", ".claude.json", ".credentials.json")

    def __init__(self, root: str):
        self.root = Path(root).resolve()

    def check(self, path: str) -> str | None:
        """Why a path may not be written: absolute, escape or blocked; None if it may."""
        if path.startswith(("/", "\\")) or path[1:2] == ":":
            return "absolute"
        depth, parts = 0, path.replace("\\", "/").split("/")
        for p in parts:
            depth += -1 if p == ".." else 0 if p in ("", ".") else 1
            if depth < 0:
                return "escape"
        if any(p in self.GUARDED for p in parts) or parts[-1].lower() in self.GUARDED_FILES or parts[1:] and parts[-1] == "hooks":
            return "blocked"
        if not (self.root / path).parent.resolve().is_relative_to(self.root) or (self.root / path).is_symlink():
            return "escape"
        return None

    def commit(self, delta: Iterable[tuple[str, str | None]]) -> None:
        """Write (path, text) and remove (path, None), one entry a path; all or nothing.

        What is replaced goes to a folder aside, one file at a time, so that memory holds
        one; a fault puts everything back."""
        with tempfile.TemporaryDirectory(prefix="textquarry-") as aside:
            done: list[tuple[str, Path | None]] = []  # path, where its old content is
            try:
                for path, text in delta:
                    if why := self.check(path):
                        raise PermissionError(f"{why}: {path}")
                    file, old = self.root / path, None
                    if file.exists():
                        if not os.access(file, os.W_OK):
                            raise PermissionError(f"not writable: {path}")
                        old = Path(aside) / str(len(done))
                        shutil.copy2(file, old)
                    done.append((path, old))
                    self._put(file, None if text is None else text.encode(), old)
            except BaseException:
                for path, old in reversed(done):
                    (self.root / path).unlink(missing_ok=True)
                    if old is not None:
                        shutil.copy2(old, self.root / path)
                raise

    def _put(self, file: Path, data: bytes | None, old: Path | None) -> None:
        if data is None:
            file.unlink(missing_ok=True)
            return
        was = old.read_bytes() if old else b""
        if was.count(b"\r\n") * 2 > was.count(b"\n"):
            data = data.replace(b"\r\n", b"\n").replace(b"\n", b"\r\n")
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)


class Audit:
    """One line per call: seconds, tool, summary; the last 10,000 are kept in memory."""

    def __init__(self, file: str | None = None, keep: int = 10_000):
        self.entries: list[tuple[int, str, str]] = []
        self.file, self.keep = file, keep

    def record(self, tool: str, summary: str) -> None:
        entry = (int(time.time()), tool, "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in summary))
        self.entries = [*self.entries, entry][-self.keep :]
        if self.file:
            with open(self.file, "a") as f:
                f.write("\t".join(map(str, entry)) + "\n")

    def table(self, spark: SparkSession) -> DataFrame:
        """at, tool, summary: the entries as a table."""
        return spark.createDataFrame(self.entries, "seconds long, tool string, summary string").select(F.timestamp_seconds("seconds").alias("at"), "tool", "summary")
