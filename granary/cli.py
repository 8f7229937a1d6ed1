"""Import Parquet into a table folder, export it again, or check that both have the same rows."""

from __future__ import annotations

import argparse
import sys

from granary.session import session
from granary.sources import store, tabular


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="granary", description=__doc__)
    parser.add_argument("source", help="Parquet file or folder; with --export a table folder")
    parser.add_argument("target", help="folder to write")
    parser.add_argument("--export", action="store_true", help="write nested Parquet from a table folder")
    parser.add_argument("--roundtrip", action="store_true", help="read the result back and compare all rows")
    parser.add_argument("--columns", nargs="*", help="columns to keep")
    parser.add_argument("--max-rows", type=int, help="rows to keep, from the start")
    parser.add_argument("--compression", default="zstd", choices=["zstd", "snappy", "gzip", "lz4", "none"])
    parser.add_argument("--overwrite", action="store_true")
    given = parser.parse_args(args)
    spark = session()
    if given.export:
        table = store.open_table(spark, given.source)
        table = table.select(given.columns) if given.columns else table
    else:
        table = tabular.read_parquet(spark, given.source, columns=given.columns, max_rows=given.max_rows)
    tabular.write_parquet(
        table, given.target, nested=given.export, compression=given.compression, mode="overwrite" if given.overwrite else "error"
    )
    if given.roundtrip:
        back = tabular.read_parquet(spark, given.target) if given.export else store.open_table(spark, given.target)
        if not tabular.same_rows(table, back):
            print("rows differ", file=sys.stderr)
            return 1
    print(f"{len(table)} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
