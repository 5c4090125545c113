"""Saved views: a name, a filter and a pattern of file names, kept in a JSON file that is rewritten whole."""

from __future__ import annotations

import fnmatch
import json
import os
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class SavedView:
    name: str
    filter: str
    files: str = "*"


def check_name(name: str) -> str:
    name = name.strip()
    if not name or len(name) > 64 or any(ord(c) < 32 for c in name):
        raise ValueError("a view's name has 1 to 64 characters and no control characters")
    return name


class SavedViews:
    """``fixed`` views come from elsewhere and aren't written; a saved one of the same name goes before them."""

    def __init__(self, path: str, fixed: list[SavedView] = ()):
        self.path, self.fixed = path, list(fixed)
        self.views: list[SavedView] = []
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    data = json.load(f)
                if data["version"] != 1:
                    raise ValueError("unknown version")
                self.views = [SavedView(**v) for v in data["views"]]
            except (ValueError, KeyError, TypeError):
                os.replace(path, f"{path}.corrupt")

    def all(self, file_name: str | None = None) -> list[SavedView]:
        merged = {v.name: v for v in [*self.fixed, *self.views]}
        return [v for v in merged.values() if file_name is None or fnmatch.fnmatch(os.path.basename(file_name), v.files)]

    def save(self, view: SavedView) -> None:
        check_name(view.name)
        self.views = [v for v in self.views if v.name != view.name] + [view]
        self._write()

    def delete(self, name: str) -> bool:
        before = len(self.views)
        self.views = [v for v in self.views if v.name != name]
        if len(self.views) < before:
            self._write()
        return len(self.views) < before

    def _write(self) -> None:
        part = f"{self.path}.partial"
        with open(part, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "views": [asdict(v) for v in self.views]}, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, self.path)
