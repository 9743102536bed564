"""Statements from the command line or standard input; rows as JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .errors import EngineError
from .language.lexer import tokens


def statements(text: str) -> list[str]:
    """The text cut after each semicolon that is a token of its own."""
    ends = [t.at + 1 for t in tokens(text) if t.kind == "mark" and t.value == ";"]
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandbase", description=__doc__)
    p.add_argument("-e", "--execute", help="statements; without it they are read from standard input")
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH[:ID]", help="a Parquet table as a collection")
    p.add_argument("--folder", help="where change log and tables are kept")
    p.add_argument("--rows", type=int, default=1000, help="most rows to print of a result")
    a = p.parse_args(argv)
    engine = Engine(spark or SparkSession.builder.getOrCreate(), a.folder)
    if a.folder and engine.log.lsn:
        engine.recover()
    for entry in a.table:
        name, _, rest = entry.partition("=")
        path, _, key = rest.rpartition(":") if ":" in rest.rsplit("/", 1)[-1] else (rest, "", "id")
        engine.register(name, engine.spark.read.parquet(path), key)
    failed = 0
    for text in statements(a.execute if a.execute is not None else sys.stdin.read()):
        try:
            for row in engine.execute(text).frame.limit(a.rows).toLocalIterator():
                print(json.dumps(row.asDict(recursive=True), default=str))
        except EngineError as e:
            failed = 1
            print(f"{type(e).__name__}: {e}", file=sys.stderr)
    return failed


if __name__ == "__main__":
    sys.exit(main())
