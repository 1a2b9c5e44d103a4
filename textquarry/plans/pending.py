"""What a request has changed so far, before any of it is committed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.edits import EditError
from ..sources.store import checkpoint

#: Changes that are prepared one by one before they become part of the plan.
HELD = 256


class Pending:
    """Files (path, text, lang) of a corpus with the changes of a request laid over them.

    Changes of single files are held here, as many as the request names; changes of
    whole scopes are part of the plan, and no text of theirs comes to the driver."""

    def __init__(self, files: DataFrame):
        self._files = files.select("path", "text", "lang", F.col("text").alias("before"))
        self._held: dict[str, tuple[str | None, str, str | None]] = {}  # text, language, text before

    def find(self, path: str) -> tuple[str, str] | None:
        """Text and language of a file as it stands; None if there is none."""
        if path in self._held:
            text, lang, _ = self._held[path]
            return None if text is None else (text, lang)
        row = self._files.filter((F.col("path") == path) & F.col("text").isNotNull()).select("text", "lang").first()
        return (row["text"], row["lang"]) if row else None

    def file(self, path: str) -> tuple[str, str]:
        found = self.find(path)
        if found is None:
            raise EditError("PATH_NOT_FOUND", path)
        return found

    def put(self, path: str, text: str | None) -> None:
        if path in self._held:
            _, lang, before = self._held[path]
        else:
            row = self._files.filter(F.col("path") == path).select("text", "lang", "before").first()
            lang, before = (row["lang"], row["before"]) if row else (paths.py_language(path, text or ""), None)
        self._held[path] = (text, lang, before)
        if len(self._held) >= HELD:
            self._files = checkpoint(self._all())
            self._held = {}

    def _all(self) -> DataFrame:
        """All files, those that are gone with a null text."""
        if not self._held:
            return self._files
        rows = [(p, t, lang, b) for p, (t, lang, b) in self._held.items()]
        own = self._files.sparkSession.createDataFrame(rows, "path string, text string, lang string, before string")
        return self._files.filter(~F.col("path").isin(list(self._held))).unionByName(own)

    @property
    def files(self) -> DataFrame:
        return self._all().filter("text is not null").select("path", "text", "lang")

    def change_all(self, text: Column, where: Column, force: bool) -> DataFrame:
        """A new text for all files that satisfy a condition; returns the files that it changes
        (path, text, lang, old).  Generated files are refused unless forced."""
        now = self._all()
        hit = F.col("text").isNotNull() & where
        new = now.withColumn("old", F.col("text")).withColumn("text", F.when(hit, text).otherwise(F.col("text")))
        changed = new.filter(~F.col("text").eqNullSafe(F.col("old"))).select("path", "text", "lang", "old")
        if not force and (row := changed.filter(paths.is_generated(F.col("path"))).select("path").first()):
            raise EditError("GENERATED", row["path"])
        # written out once: later steps and the commit read it, and the tree may change meanwhile
        self._files, self._held = checkpoint(new.drop("old")), {}
        return changed

    def changes(self) -> DataFrame:
        """path, text (null: deleted), before of all files that differ from the committed ones."""
        return self._all().filter(~F.col("text").eqNullSafe(F.col("before"))).select("path", "text", "before")
