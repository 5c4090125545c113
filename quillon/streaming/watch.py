"""Noticing that an opened file has changed, so that it can be read again."""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession

from quillon.sources.source import Source


class Watcher:
    """Looks at a file's length and time; tells each change once."""

    def __init__(self, path: str, every: float = 2.0):
        self.path, self.every, self.last, self.at = path, every, self._stat(path), time.monotonic()

    @staticmethod
    def _stat(path: str) -> tuple[int, int] | None:
        try:
            s = os.stat(path)
            return s.st_size, s.st_mtime_ns
        except OSError:
            return None

    def poll(self, now: float | None = None) -> str | None:
        """``changed``, ``deleted`` or None; looks at most once in ``every`` seconds."""
        now = time.monotonic() if now is None else now
        if now - self.at < self.every:
            return None
        self.at, seen = now, self._stat(self.path)
        if seen == self.last:
            return None
        self.last = seen
        return "deleted" if seen is None else "changed"

    def reload(self, spark: SparkSession, source: Source) -> Source:
        """The source opened anew, under the overrides it was opened with; views on the old one keep what they have."""
        return source.reopen(spark)
