"""Column edits: chains of small text operations, each a Column expression.

Positions count grapheme clusters, which Java's ``\\X`` splits inside Spark. Null and missing values stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import regexes

UNICODE_SPACE = r"\p{IsWhite_Space}"


class EditError(ValueError):
    """Message and the span of the input that it's about."""

    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.message, self.span = message, (start, end)


def graphemes(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"\X"), F.lit(0))


def quoted(s: str) -> str:
    """Bare if it reads back the same, else in quotes."""
    if s and s[0] != "-" and not any(c.isspace() or c in '|"\\' for c in s):
        return s
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\t", "\\t").replace("\n", "\\n") + '"'


@dataclass(frozen=True)
class Slice:
    start: int | None
    end: int | None
    form: str = "slice"

    def column(self, s: Column) -> Column:
        g = graphemes(s)
        size = F.size(g)
        at = lambda n: F.least(F.lit(n), size) if n >= 0 else F.greatest(size + n, F.lit(0))
        a = F.lit(0) if self.start is None else at(self.start)
        b = size if self.end is None else at(self.end)
        return F.when(a < b, F.array_join(F.slice(g, a + 1, F.greatest(b - a, F.lit(0))), "")).otherwise("")

    def __str__(self) -> str:
        if self.form != "slice":
            return f"{self.form} {-self.end if self.form == 'chop' else self.start if self.form == 'drop' else self.end}"
        return f"slice {'' if self.start is None else self.start}:{'' if self.end is None else self.end}"


@dataclass(frozen=True)
class Trim:
    name: str
    chars: str | None = None

    def column(self, s: Column) -> Column:
        if self.chars is not None:
            chars = F.lit(self.chars)
            return {"trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim}[self.name](s, chars)
        left, right = rf"\A{UNICODE_SPACE}+", rf"{UNICODE_SPACE}+\z"
        return F.regexp_replace(s, {"trim": f"{left}|{right}", "ltrim": left, "rtrim": right}[self.name], "")

    def __str__(self) -> str:
        return self.name if self.chars is None else f"{self.name} {quoted(self.chars)}"


@dataclass(frozen=True)
class Case:
    name: str

    def column(self, s: Column) -> Column:
        if self.name != "title":
            return F.upper(s) if self.name == "upper" else F.lower(s)
        words = F.regexp_extract_all(s, F.lit(r"[\p{IsAlphabetic}\p{N}']+|[^\p{IsAlphabetic}\p{N}']+"), F.lit(0))
        return F.array_join(F.transform(words, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2**31 - 1)))), "")

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Pad:
    name: str
    width: int
    fill: str = " "

    def column(self, s: Column) -> Column:
        missing = F.lit(self.width) - F.size(graphemes(s))
        fill = F.repeat(F.lit(self.fill), F.greatest(missing, F.lit(0)))
        return F.concat(fill, s) if self.name == "lpad" else F.concat(s, fill)

    def __str__(self) -> str:
        return f"{self.name} {self.width}" + (f" {quoted(self.fill)}" if self.fill != " " else "")


@dataclass(frozen=True)
class Affix:
    name: str
    text: str

    def column(self, s: Column) -> Column:
        return F.concat(F.lit(self.text), s) if self.name == "prefix" else F.concat(s, F.lit(self.text))

    def __str__(self) -> str:
        return f"{self.name} {quoted(self.text)}"


@dataclass(frozen=True)
class Replace:
    old: str
    new: str

    def column(self, s: Column) -> Column:
        return F.replace(s, F.lit(self.old), F.lit(self.new))

    def __str__(self) -> str:
        return f"replace {quoted(self.old)} {quoted(self.new)}"


@dataclass(frozen=True)
class Substitute:
    pattern: str
    new: str
    every: bool = False
    ci: bool = False

    def column(self, s: Column) -> Column:
        java = regexes.to_java(self.pattern, self.ci)
        if self.every:
            return F.regexp_replace(s, java, regexes.replacement(self.new, self.pattern).replace("$ALL", "$0"))
        flags = regexes.FLAGS + ("(?i)" if self.ci else "")
        rep = regexes.replacement(self.new, self.pattern, 2).replace("$ALL", "$2")
        return F.regexp_replace(s, rf"{flags}\A([\s\S]*?)({java[len(flags):]})", "$1" + rep)

    def __str__(self) -> str:
        d = next((d for d in "/#|!@%,;~" if d not in self.pattern and d not in self.new), "/")
        return f"s{d}{self.pattern}{d}{self.new}{d}" + "g" * self.every + "i" * self.ci


Op = Slice | Trim | Case | Pad | Affix | Replace | Substitute


#: One token of a chain: blanks, the bar, text in quotes (or a quote left open), a bare word.
_TOKEN = re.compile(r'(?P<blank>\s+)|(?P<bar>\|)|"(?P<quoted>(?:[^"\\]|\\.)*)"|(?P<open>"[\s\S]*)|(?P<word>[^\s|]+)', re.S)
#: A substitution, which reads to its own delimiter; the delimiter is any ASCII punctuation.
_SUBSTITUTION = re.compile(r"s(?P<d>[!-/:-@\[-`{-~])(?:(?P<old>(?:(?!(?P=d))(?:\\.|[^\\]))*)(?P=d)(?P<new>(?:(?!(?P=d))(?:\\.|[^\\]))*)(?P=d)(?P<flags>[^\s|]*))?", re.S)
_RANGE = re.compile(r"([+-]?[0-9]+)?:([+-]?[0-9]+)?")


@dataclass(frozen=True)
class _Word:
    text: str
    start: int
    end: int
    bare: bool = True


def _count(name: str, w: _Word) -> int:
    if not w.bare or not re.fullmatch(r"\+?[0-9]+", w.text):
        raise EditError(f"{name} takes a count, and {w.text} is none", w.start, w.end)
    return int(w.text)


def _range(name: str, w: _Word) -> tuple[int | None, int | None]:
    ends = _RANGE.fullmatch(w.text) if w.bare else None
    if not ends:
        raise EditError(f"{name} takes a range such as 2:5, 1: or :-1, and {w.text} is none", w.start, w.end)
    return tuple(int(x) if x else None for x in ends.groups())


def _fill(name: str, w: _Word) -> str:
    if not regex.fullmatch(r"\X", w.text):
        raise EditError(f"{name} fills with one character", w.start, w.end)
    return w.text


def _sought(name: str, w: _Word) -> str:
    if not w.text:
        raise EditError(f"{name} needs something to look for", w.start, w.end)
    return w.text


def _any(name: str, w: _Word) -> str:
    return w.text


#: What may be missing at the end of an edit's arguments is None here; the others are said to be missing by this name.
_NEEDED = {_count: "a count", _range: "a range", _any: "a text", _sought: "a text to look for"}
#: How each edit is written: the readers of its arguments, how many of them may be left out, and what they make.
_EDITS = {
    "drop": ((_count,), 0, lambda n: Slice(n, None, "drop")),
    "chop": ((_count,), 0, lambda n: Slice(None, -n, "chop")),
    "take": ((_count,), 0, lambda n: Slice(None, n, "take")),
    "slice": ((_range,), 0, lambda ends: Slice(*ends)),
    **{name: ((_any,), 1, lambda chars=None, name=name: Trim(name, chars or None)) for name in ("trim", "ltrim", "rtrim")},
    **{name: ((), 0, lambda name=name: Case(name)) for name in ("upper", "lower", "title")},
    **{name: ((_count, _fill), 1, lambda n, fill=" ", name=name: Pad(name, n, fill)) for name in ("lpad", "rpad")},
    **{name: ((_any,), 0, lambda text, name=name: Affix(name, text)) for name in ("prefix", "suffix")},
    "replace": ((_sought, _any), 0, Replace),
}


def _substitution(found: re.Match, end: int) -> Substitute:
    d = found["d"]
    if found["old"] is None:
        raise EditError(f"this substitution stops short of s{d}pattern{d}text{d}", found.start(), end)
    old, new = (re.sub(r"\\(.)", lambda m: d if m[1] == d else m[0], found[part], flags=re.S) for part in ("old", "new"))
    for k, flag in enumerate(found["flags"], found.start("flags")):
        if flag not in "gi":
            raise EditError(f"a substitution has the flags g and i, not {flag}", k, k + 1)
    try:
        regexes.check(old)
    except ValueError as e:
        raise EditError(f"the pattern can't be read: {e}", *found.span("old")) from None
    return Substitute(old, new, "g" in found["flags"], "i" in found["flags"])


def _chain(text: str) -> Iterator[tuple[int, int, Substitute | None, list[_Word]]]:
    """Each edit between bars: where it begins and ends, and either a substitution or its words."""
    at, begin, words, made = 0, 0, [], None
    while at < len(text):
        if not words and made is None and (found := _SUBSTITUTION.match(text, at)):
            made = _substitution(found, len(text))
            at = found.end()
            continue
        token = _TOKEN.match(text, at)
        at = token.end()
        if token["open"] is not None:
            raise EditError("this text has no closing quote", token.start(), len(text))
        if token["bar"]:
            yield begin, token.start(), made, words
            begin, words, made = at, [], None
        elif token["quoted"] is not None:
            said = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), token["quoted"], flags=re.S)
            words.append(_Word(said, *token.span(), bare=False))
        elif token["word"]:
            words.append(_Word(token["word"], *token.span()))
    yield begin, len(text), made, words


def parse_ops(text: str) -> list[Op]:
    """``op ("|" op)*``, at least one."""
    out: list[Op] = []
    for begin, end, made, words in _chain(text):
        if made is not None:
            extra = words
        elif not words:
            raise EditError("no edit follows the |" if begin else "nothing to do: name an edit, such as drop 1", end, end)
        else:
            name, arguments = words[0].text, words[1:]
            if name not in _EDITS or not words[0].bare:
                raise EditError(f"there is no edit {name} ({', '.join(_EDITS)}, s/pattern/text/)", words[0].start, words[0].end)
            readers, optional, make = _EDITS[name]
            if len(arguments) < len(readers) - optional:
                raise EditError(f"{name} takes {_NEEDED[readers[len(arguments)]]}", end, end)
            made = make(*(read(name, w) for read, w in zip(readers, arguments, strict=False)))
            extra = arguments[len(readers) :]
        if extra:
            raise EditError(f"{extra[0].text} comes where | or the end belongs", extra[0].start, extra[0].end)
        out.append(made)
    return out


def apply(s: Column, ops: list[Op] | tuple[Op, ...], is_null: Column | None = None) -> Column:
    """The edited text; texts that spell null, and missing ones, stay."""
    out = s
    for op in ops:
        out = op.column(out)
    return out if is_null is None or not ops else F.when(is_null, s).otherwise(out)
