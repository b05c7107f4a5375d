"""Command line: queries, audits, reports, comparisons and scheduled runs.

python -m siteloom.cli list
python -m siteloom.cli run NAME SF_DIR [--out PATH] [--format csv|json|parquet|xml]
python -m siteloom.cli audit PAGES_DIR STORE DOMAIN AUDIT_ID
python -m siteloom.cli schedule PAGES_DIR STORE DOMAIN AUDIT_ID
python -m siteloom.cli audits STORE
python -m siteloom.cli report STORE DOMAIN AUDIT_ID --out FILE
python -m siteloom.cli compare STORE BASE OTHER [--out PATH] [--format ...]
python -m siteloom.cli delete STORE AUDIT_ID
"""

from __future__ import annotations

import argparse
import json


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siteloom")
    sub = out.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, places in {"run": "name sf_dir", "audit": "pages_dir store domain audit_id", "schedule": "pages_dir store domain audit_id", "audits": "store", "report": "store domain audit_id", "compare": "store base other", "delete": "store audit_id"}.items():
        p = sub.add_parser(name)
        for place in places.split():
            p.add_argument(place)
        if name in ("run", "compare", "report"):
            p.add_argument("--out")
            p.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "xml", "text"])
    return out


def show(df, args) -> None:
    from .operators import exports

    if args.out:
        exports.write(df, args.out, args.format)
    else:
        df.show(50, truncate=80)


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from .operators import audits, store
    from .plans import registry

    given = parser()
    args = given.parse_args(argv)
    found = registry.queries()
    if args.command == "list":
        print("\n".join(sorted(found)))
        return 0
    if args.command == "run" and args.name not in found:
        given.error(f"no query {args.name}")
    spark = SparkSession.builder.appName("siteloom").getOrCreate()
    if args.command == "run":
        show(found[args.name](spark, args.sf_dir), args)
    elif args.command in ("audit", "schedule"):
        run = audits.run_audit if args.command == "audit" else audits.run_and_compare
        print(json.dumps(run(spark, args.pages_dir, args.store, args.domain, args.audit_id)))
    else:
        s = store.Store(spark, args.store)
        if args.command == "audits":
            store.list_audits(s.scan("audits")).show(50, truncate=80)
        elif args.command == "compare":
            show(audits.compare_audits(s, args.base, args.other), args)
        elif args.command == "delete":
            for table in ("audits", "issues", *(n.removeprefix("fx_") for n in audits.KEPT)):
                s.delete_audit(table, args.audit_id)
        else:
            text = audits.report(s, args.audit_id, args.domain)
            if args.out:
                with open(args.out, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
