"""``python -m facetlake.cli validate STORE``: exit code 0 when sound, 1 with errors, 2 when it cannot be read."""

from __future__ import annotations

import argparse
import json
import sys

from facetlake.operators import validate
from facetlake.schema import StoreError
from facetlake.session import local_session
from facetlake.store import Store

MOST_SHOWN = 1000


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="facetlake")
    commands = parser.add_subparsers(dest="command", required=True)
    v = commands.add_parser("validate", help="check a store")
    v.add_argument("store")
    v.add_argument("--level", choices=validate.LEVELS, default="basic")
    v.add_argument("--format", choices=["text", "json"], default="text")
    v.add_argument("--base-dir", default=".")
    args = parser.parse_args(argv)
    spark = local_session()
    try:
        store = Store.open(spark, args.store)
    except (StoreError, FileNotFoundError) as e:
        print(f"cannot open {args.store}: {e}", file=sys.stderr)
        return 2
    skipped: list[tuple[str, str]] = []
    issues = validate.run({**store.tables(), "header": store.header()}, args.level, base_dir=args.base_dir, skipped=skipped).cache()
    counts = {r["severity"]: r["count"] for r in issues.groupBy("severity").count().collect()}
    shown = [r.asDict() for r in issues.orderBy("severity", "code", "row_id").limit(MOST_SHOWN).collect()]
    if args.format == "json":
        print(json.dumps({"errors": counts.get("error", 0), "warnings": counts.get("warning", 0), "issues": shown, "not_checked": [c for c, _ in skipped]}))
    else:
        for r in shown:
            print(f"{r['severity'].upper()} {r['code']} {r['table_name']} {r['row_id']} {r['details']}".rstrip())
        print(f"{counts.get('error', 0)} errors, {counts.get('warning', 0)} warnings")
    return 1 if counts.get("error") else 0


if __name__ == "__main__":
    sys.exit(main())
