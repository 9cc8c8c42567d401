"""Command line: a store's setup, ingestion, builds and queries."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from tidemark.operators.master import MasterError
from tidemark.sources.archives import FormatError
from tidemark.sources.store import Store, StoreError, resolve_root


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    parser.add_argument("--root", help="the store's root; else TIDEMARK_ROOT")
    parser.add_argument("--master", help="Spark master; else that of the environment")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="make the zones of a store")
    ingest = commands.add_parser("ingest", help="read annual archives into curated/bars")
    ingest.add_argument("files", nargs="+", help="paths or patterns of archives")
    build = commands.add_parser("build", help="build a table of the store")
    build.add_argument("what", nargs="?", choices=("spans", "bars", "master"), default="spans", help="curated/spans or curated/master from bars, or curated/bars from raw archives")
    build.add_argument("--overrides", help="a YAML file of links made by hand, for the master")
    build.add_argument("--years", type=int, nargs="*", help="years of bars; all there are, if none is named")
    commands.add_parser("years", help="what each year of curated/bars was built from")
    review = commands.add_parser("review", help="print candidates that wait for a decision")
    review.add_argument("--status", nargs="*", default=["conflict", "likely", "pending"])
    show = commands.add_parser("show", help="print rows of a table")
    show.add_argument("zone")
    show.add_argument("name")
    show.add_argument("--rows", type=int, default=20)
    return parser


def main(argv: Sequence[str] | None = None) -> int:
    """0 if done, 2 if the input or the store is at fault."""
    args = _parser().parse_args(argv)
    try:
        root = resolve_root(args.root)
        if args.command == "init":
            print(Store.initialize(root).root)
            return 0
        store = Store.open(root)
        return _with_spark(args, store)
    except (StoreError, FormatError, MasterError, FileNotFoundError) as error:
        print(f"tidemark: {error}", file=sys.stderr)
        return 2


def _print_years(entries: dict[int, dict]) -> None:
    for year, entry in sorted(entries.items()):
        print(f"{year}: {entry['file']}, {entry['records_read']} records, {entry['rows_kept']} bars on {entry['sessions']} sessions")


def _with_spark(args: argparse.Namespace, store: Store) -> int:
    from pyspark.sql import functions as F

    from tidemark.builds import build_master
    from tidemark.operators.identity import spans
    from tidemark.session import get_session
    from tidemark.sources.annual import build_years, ingest, read_manifest
    from tidemark.sources.files import files

    spark = get_session("tidemark", args.master)
    if args.command == "ingest":
        paths = sorted({p for pattern in args.files for p in files(spark).matching(pattern)})
        if not paths:
            raise FileNotFoundError(f"no file matches {' '.join(args.files)}")
        _print_years(ingest(spark, store, paths))
    elif args.command == "build" and args.what == "bars":
        _print_years(build_years(spark, store, args.years or None))
    elif args.command == "build" and args.what == "master":
        print(json.dumps(build_master(spark, store, args.overrides), indent=1, sort_keys=True))
    elif args.command == "build":
        found = spans(store.read(spark, "curated", "bars"), ["symbol", "label"], "session")
        print(store.replace(found, "curated", "spans"))
    elif args.command == "years":
        _print_years(read_manifest(store))
    elif args.command == "review":
        rows = store.read(spark, "curated", "candidates").where(F.col("status").isin(args.status))
        rows.orderBy("status", "from_", "to_").show(1000, truncate=False)
    else:
        store.read(spark, args.zone, args.name).show(args.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
