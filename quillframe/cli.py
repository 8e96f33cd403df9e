"""Command line: python -m quillframe [QUERY] [options]. Without QUERY, the program is read from standard input."""

from __future__ import annotations

import argparse
import sys

from .engine import execute
from .plans.parser import ParseError, parse_program
from .render import renderer
from .sources.documents import Options
from .sources.languages import SyntaxChoiceError, chosen
from .sources.listing import SourceError
from . import VERSION

USAGE_ERROR, RUN_ERROR = 2, 1


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillframe", description="Query and edit the headers of text files.")
    p.add_argument("query", nargs="?")
    p.add_argument("-d", "--dry-run", action="store_true", help="change nothing")
    p.add_argument("-s", "--silent", action="store_true", help="print no results")
    p.add_argument("-v", "--verbose", action="store_true", help="print the rows that update and alter change")
    p.add_argument("--max-columns", type=int, default=0, help="columns that select * shows (20)")
    p.add_argument("--format", default="full", help="simple, full, csv or markdown")
    p.add_argument("-H", "--hidden", "--include-hidden", action="store_true", help="also hidden files")
    p.add_argument("-L", "--lang", default="", help="comment syntax of all files: a language or an extension")
    p.add_argument("--line-comment", default="")
    p.add_argument("--block-open", default="")
    p.add_argument("--block-close", default="")
    p.add_argument("-V", "--version", action="version", version=VERSION)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        args = arguments().parse_args(argv)
    except SystemExit as e:
        return USAGE_ERROR if e.code else 0
    try:
        renderer(args.format)
        language = chosen(args.lang, args.line_comment, args.block_open, args.block_close)
        text = args.query if args.query is not None else sys.stdin.read()
        try:
            program = parse_program(text)
        except ParseError as e:
            raise ValueError(f"parse: {e}") from None
        if not program.statements:
            raise ValueError("empty query")
    except (ValueError, SyntaxChoiceError) as e:
        print(e, file=sys.stderr)
        return USAGE_ERROR
    if spark is None:
        from .session import local_session

        spark = local_session("*", memory="2g")
    options = Options(args.dry_run, args.verbose, args.hidden, args.max_columns if args.max_columns > 0 else 20, language)
    try:
        return 0 if execute(spark, text, options, args.format, silent=args.silent) else RUN_ERROR
    except SourceError as e:
        print(e, file=sys.stderr)
        return RUN_ERROR
