"""Commands: ``C`` ingests, ``F`` counts by an equality filter, ``R`` looks rows up, ``S`` scans, ``Q`` ends.

    C in.csv out 10 20 0,1     columns 0 and 1 of 20 rows from row 10 on
    F out 1 value 0,1          rows whose column 1 is "value"; ``count`` for their number alone
    R out 15,100 0,1           columns 0 and 1 of rows 15 and 100
    S out 0,1                  columns 0 and 1 of every row
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .operators.table import Table, equi_filter, formatted, lookup, scan
from .session import session
from .sources.text import ingest, parse_columns


def _show(rows: DataFrame, out: TextIO) -> int:
    n = 0
    for n, row in enumerate(formatted(rows).toLocalIterator(), 1):
        print(row.line, file=out)
    return n


def run(spark: SparkSession, line: str, out: TextIO = sys.stdout) -> bool:
    """Do one command; False ends."""
    verb, *args = line.split() or [""]
    began = time.perf_counter()
    if verb == "C" and len(args) == 5:
        n = ingest(spark, args[0], args[1], int(args[2]), int(args[3]), parse_columns(args[4]))
        said = f"ingested {n} rows"
    elif verb == "F" and len(args) == 4:
        table = Table.open(spark, args[0])
        said = f"{equi_filter(table, int(args[1]), args[2], []).first().n} rows" if not parse_columns(args[3]) else f"{_show(equi_filter(table, int(args[1]), args[2], parse_columns(args[3]), ordered=True), out)} rows"
    elif verb == "R" and len(args) == 3:
        said = f"{_show(lookup(Table.open(spark, args[0]), [int(r) for r in args[1].split(',')], parse_columns(args[2])).drop('req_pos'), out)} rows"
    elif verb == "S" and len(args) == 2:
        said = f"{_show(scan(Table.open(spark, args[0]), parse_columns(args[1]), ordered=True), out)} rows"
    elif verb == "Q":
        return False
    else:
        said = __doc__.strip()
    print(f"{said}, {time.perf_counter() - began:.3f} s", file=out)
    return True


def main(lines: Iterable[str] = sys.stdin) -> None:
    spark = session()
    for line in lines:
        try:
            if not run(spark, line):
                break
        except Exception as error:  # noqa: BLE001  a command that fails doesn't end the loop
            print(f"failed: {error}", file=sys.stderr)


if __name__ == "__main__":
    main()
