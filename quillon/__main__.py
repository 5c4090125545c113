"""python -m quillon FILE: open a delimited file, filter, sort, deduplicate; show rows, profile or export."""

from __future__ import annotations

import argparse

from quillon.sources.dialect import ALIASES, UNSET, Overrides


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("file", help="a path, or - for standard input")
    p.add_argument("-d", "--delimiter")
    p.add_argument("-q", "--quote", help="a character, or none")
    p.add_argument("--escape", choices=("doubled", "backslash"))
    p.add_argument("--header", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--encoding")
    p.add_argument("--comment")
    p.add_argument("--filter")
    p.add_argument("--sort")
    p.add_argument("--dedupe", nargs="?", const="")
    p.add_argument("--profile", action="store_true")
    p.add_argument("--export")
    p.add_argument("--rows", type=int, default=20)
    return p.parse_args(argv)


def overrides(a: argparse.Namespace) -> Overrides:
    named = {"tab": "\t", "\\t": "\t", "space": " ", "comma": ",", "pipe": "|", "semicolon": ";"}
    quote = UNSET if a.quote is None else None if a.quote == "none" else a.quote
    return Overrides(named.get(a.delimiter, a.delimiter), quote, a.escape, a.header, ALIASES.get(a.encoding, a.encoding), a.comment)


def main(argv: list[str] | None = None, spark=None) -> None:
    from pyspark.sql import SparkSession

    from quillon.operators import export, profile
    from quillon.operators.views import open_view

    a = arguments(argv)
    spark = spark or SparkSession.builder.appName("quillon").getOrCreate()
    stack = open_view(spark, a.file, a.filter, a.sort, overrides=overrides(a))
    if a.dedupe is not None:
        stack.dedupe(a.dedupe or None)
    view = stack.active
    if a.profile:
        for s in profile.profile(view.source):
            print(s)
    elif a.export:
        print(f"{export.export(view, a.export)} records")
    else:
        chosen = view.source.visible()
        print(export.format_record([c.display for c in chosen]))
        for r in export.lines(view).limit(a.rows).collect():
            print(r[0])


if __name__ == "__main__":
    main()
