"""Column names: unique query names, lookup by what a user types."""

from __future__ import annotations

from collections import Counter

from quillon.functions.text import levenshtein


def column_names(header: list[str] | int) -> list[tuple[str, str]]:
    """(display, query) names. A number stands for a headerless file of so many columns.

    An empty name becomes colN. Query names are trimmed; a repeated one takes the next suffix _2, _3 ... that no
    column has as its own name.
    """
    if isinstance(header, int):
        return [(f"col{i}", f"col{i}") for i in range(1, header + 1)]
    named = [(h, h.strip()) if h.strip() else (f"col{i}", f"col{i}") for i, h in enumerate(header, 1)]
    own, used, seen, out = {q for _, q in named}, set(), Counter(), []
    for display, query in named:
        seen[query] += 1
        name, k = query, max(seen[query], 2)
        if seen[query] > 1 or query in used:
            while (name := f"{query}_{k}") in own or name in used:
                k += 1
        used.add(name)
        out.append((display, name))
    return out


class NameError_(ValueError):
    """No column, or several, for what was typed."""


def match_column(text: str, columns: list[tuple[str, str]]) -> int:
    """Exact display name, exact query name, a name alike but for case, or the beginning of one; several are an error."""
    text = text.strip()
    for which in (0, 1):
        for i, names in enumerate(columns):
            if names[which] == text:
                return i
    low = text.lower()
    for test in (lambda n: n == low, lambda n: n.startswith(low)):
        found = [i for i, names in enumerate(columns) if any(test(n.lower()) for n in names)]
        if len(found) == 1:
            return found[0]
        if found:
            raise NameError_("ambiguous: " + ", ".join(columns[i][0] for i in found))
    raise NameError_(f"no column {text}")


def goto_column(text: str, columns: list[tuple[str, str]]) -> int:
    """As ``match_column``, but of several names alike but for case the first will do."""
    low = text.strip().lower()
    exact = any(text.strip() in names for names in columns)
    alike = [i for i, names in enumerate(columns) if low in (n.lower() for n in names)]
    return alike[0] if alike and not exact else match_column(text, columns)


def suggestion(name: str, names: list[str]) -> str | None:
    """The nearest name within two edits."""
    best = min(names, key=lambda n: levenshtein(name, n), default=None)
    return best if best is not None and levenshtein(name, best) <= 2 else None
