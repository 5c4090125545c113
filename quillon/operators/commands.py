"""The command line of the workbench: text to an invocation, and invocations on a stack of views."""

from __future__ import annotations

from dataclasses import dataclass

from quillon.operators import export as exports
from quillon.operators.profile import profile
from quillon.operators.saved import SavedViews
from quillon.operators.views import ViewStack
from quillon.plans.names import NameError_, goto_column, match_column

COMMANDS = ("sort", "filter", "set type", "set hints", "set inspector", "freeze", "profile", "open", "export", "goto", "edit", "reset edits", "dupes", "dedupe", "delete view")


class CommandError(ValueError):
    pass


@dataclass(frozen=True)
class Invocation:
    name: str
    args: str = ""


def parse(text: str) -> Invocation:
    """The longest command that the text begins with; ``view: name`` for a saved view."""
    text = text.strip()
    if text.startswith("view:"):
        return Invocation("view", text[5:].strip())
    for name in sorted(COMMANDS, key=len, reverse=True):
        words = name.split()
        given = text.split(None, len(words))
        if given[: len(words)] == words:
            return Invocation(name, given[len(words)] if len(given) > len(words) else "")
    raise CommandError(f"unknown command {text.split()[0] if text else ''!r} ({', '.join(COMMANDS)})")


def split_edit(args: str, source) -> tuple[str, str]:
    """(column, operations) of ``col: ops``: the longest exact name before a colon, else what the name rules find."""
    colons = [i for i, c in enumerate(args) if c == ":"]
    for i in reversed(colons):
        if any(args[:i].strip() in names for names in source.names):
            return args[:i].strip(), args[i + 1 :]
    if not colons:
        raise CommandError("expected a column and a colon, e.g. edit name: upper")
    return source.columns[match_column(args[: colons[0]], source.names)].display, args[colons[0] + 1 :]


class Workbench:
    """A stack of views on one source, driven by commands."""

    def __init__(self, spark, stack: ViewStack, saved: SavedViews | None = None):
        self.spark, self.stack, self.saved = spark, stack, saved
        self.display = {"hints": True, "inspector": False, "freeze": 0}

    @property
    def source(self):
        return self.stack.active.source

    def run(self, text: str):
        """The new view, the profile, the position or the number of exported rows, by the command."""
        c = parse(text)
        match c.name:
            case "filter":
                return self.stack.filter(c.args)
            case "sort":
                return self.stack.sort(c.args)
            case "dupes":
                return self.stack.dupes(c.args or None)
            case "dedupe":
                return self.stack.dedupe(c.args or None)
            case "set type":
                name, _, label = c.args.rpartition(" ")
                if not name:
                    raise CommandError("expected a column and a type")
                return self.stack.rebase(self.source.set_type(name, label))
            case "edit":
                name, ops = split_edit(c.args, self.source)
                return self.stack.rebase(self.source.edit(name, ops))
            case "reset edits":
                return self.stack.rebase(self.source.reset_edits())
            case "profile":
                return profile(self.source, None if c.args in ("", "all") else [c.args])
            case "export":
                return exports.export(self.stack.active, c.args or exports.default_target(self.stack.active))
            case "goto":
                try:
                    return self.stack.active.goto(c.args)
                except ValueError:
                    try:
                        return self.source.columns[goto_column(c.args, self.source.names)]
                    except NameError_ as e:
                        raise CommandError(str(e)) from None
            case "open":
                from quillon.sources.source import Source

                self.stack = ViewStack(Source.open(self.spark, c.args))
                return self.stack.active
            case "view":
                found = [v for v in (self.saved.all(self.source.path) if self.saved else ()) if v.name == c.args]
                if not found:
                    raise CommandError(f"no view {c.args}")
                return self.stack.filter(found[0].filter)
            case "delete view":
                if not (self.saved and self.saved.delete(c.args)):
                    raise CommandError(f"no view {c.args}")
            case "set hints" | "set inspector":
                self.display[c.name[4:]] = c.args != "off"
            case "freeze":
                self.display["freeze"] = int(c.args or 1)
        return None
