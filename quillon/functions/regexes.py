"""Regular expressions of the filter language in Java's dialect.

The language's expressions are Unicode-aware, ``.`` leaves out only the line feed, and ``$`` without ``(?m)`` is the
very end. Look-around and back-references are no part of it. Java reads the rest alike once it is told so.
"""

from __future__ import annotations

import re

import regex

#: Unix lines, Unicode classes (which also makes (?i) Unicode-aware).
FLAGS = "(?dU)"
_POSIX = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "space": r"\s", "punct": r"\p{Punct}", "word": r"\w", "xdigit": "0-9A-Fa-f", "blank": r"\t ", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "ascii": r"\x00-\x7F"}


def check(pattern: str) -> None:
    """ValueError if the pattern is not an expression of the language."""
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    if re.search(r"\(\?(?:[=!>|R]|<[=!])", bare):
        raise ValueError("patterns have no look-around")
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\k<", pattern):
        raise ValueError("patterns have no back-references")
    try:
        regex.compile(pattern)
    except regex.error as e:
        raise ValueError(str(e)) from None


def groups(pattern: str) -> tuple[int, dict[str, int]]:
    compiled = regex.compile(pattern)
    return compiled.groups, dict(compiled.groupindex)


def to_java(pattern: str, ci: bool = False) -> str:
    """The pattern in Java's dialect; ``check`` it first."""
    out, i, n, in_class = [FLAGS + ("(?i)" if ci else "")], 0, len(pattern), 0
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            if c == "[" and (found := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])) and found[2] in _POSIX:
                body = _POSIX[found[2]]
                out.append(f"[^{body}]" if found[1] else body)
                i += found.end()
                continue
            in_class += (c == "[") - (c == "]")
            out.append(c)
        elif c == "[":
            in_class = 1
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                i += 1
                out.append("^")
            if pattern[i + 1 : i + 2] == "]":  # a bracket that comes first is itself
                i += 1
                out.append("\\]")
        elif c == "$" and not multiline:
            out.append("\\z")
        elif c == "(" and (found := re.match(r"\(\?P?<(\w+)>", pattern[i:])):
            out.append("(")
            i += found.end()
            continue
        else:
            out.append(c)
        i += 1
    return "".join(out)


def replacement(rep: str, pattern: str, shift: int = 0) -> str:
    """``$1``, ``${name}``, ``$name``, ``$$`` as Java writes them; a group that the pattern lacks gives nothing."""
    count, names = groups(pattern)
    out, i = [], 0
    while i < len(rep):
        c = rep[i]
        found = re.match(r"\$(?:(\$)|(\w+)|\{([^}]*)\})", rep[i:], re.A) if c == "$" else None
        if found:
            i += found.end()
            name = found[2] or found[3]
            if found[1]:
                out.append("\\$")
            else:
                number = int(name) if name.isdigit() else names.get(name)
                if number is not None and number <= count:
                    out.append(f"${number + shift if number or not shift else 'ALL'}")
                    if i < len(rep) and rep[i].isdigit():
                        out.append("\\" + rep[i])
                        i += 1
            continue
        out.append("\\" + c if c in "\\$" else c)
        i += 1
    return "".join(out)
