"""Command line: generate, verify, fmt and schema.

    python -m histlens.cli verify --consistency serializable DIR [--verbose | --json]
"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

from pyspark.sql import SparkSession

from .functions import dsl
from .model import Level, from_nested, parse_level


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="histlens")
    sub = top.add_subparsers(dest="command", required=True)
    gen = sub.add_parser("generate", help="write random histories as JSON")
    for name, value in (("n-hist", 10), ("n-node", 3), ("n-variable", 5), ("n-transaction", 5), ("n-event", 3), ("seed", 0)):
        gen.add_argument(f"--{name}", type=int, default=value)
    gen.add_argument("--output-dir", required=True)
    ver = sub.add_parser("verify", help="check history files; exit code 1 if one fails")
    ver.add_argument("path")
    ver.add_argument("--consistency", required=True, choices=[str(x) for x in Level])
    ver.add_argument("--verbose", action="store_true")
    ver.add_argument("--json", action="store_true", help="one JSON object a file")
    fmt = sub.add_parser("fmt", help="rewrite .hist files in the standard form")
    fmt.add_argument("paths", nargs="+")
    fmt.add_argument("--check", action="store_true", help="change nothing; exit code 1 if a file would change")
    sub.add_parser("schema", help="print the JSON Schema of a history")
    return top


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("histlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def generate(args: argparse.Namespace) -> int:
    from .sources import generate as g
    from .sources.json_files import write_wrapped

    write_wrapped(g.generate(_spark(), args.n_hist, args.n_node, args.n_variable, args.n_transaction, args.n_event, args.seed), args.output_dir)
    return 0


def verify(args: argparse.Namespace) -> int:
    """Files in order of their paths, one at a time: nothing is held for all of them."""
    from .plans import check as checks
    from .sources.json_files import read

    level = parse_level(args.consistency)
    files = read(_spark(), args.path)
    bad = files.where("sessions IS NULL").select("h", "message", "line", "column")
    done = checks.check(from_nested(files.where("sessions IS NOT NULL")), level, witness=args.verbose or args.json)
    failed = False
    for r in done.unionByName(bad, allowMissingColumns=True).orderBy("h").toLocalIterator():
        if r["message"] is not None:
            x = {"ok": False, "error": {"kind": "Parse", "message": r["message"], "line": r["line"], "column": r["column"]}}
        elif r["ok"]:
            witness = next((x for x in (r["commit_order"], r["split_order"], r["saturation_edges"]) if x is not None), None)
            x = {"ok": True, "witness": {r["witness_kind"]: [w.asDict(True) for w in witness]} if witness is not None else None}
        else:
            x = {"ok": r["ok"], "error": {"kind": r["error_kind"], "level": r["error_level"], "code": r["error_code"], "where": r["error_where"]}}
        failed |= not x["ok"]
        name = pathlib.PurePosixPath(r["h"]).name
        if args.json:
            print(json.dumps({"file": name} | x))
        else:
            said = "PASS" if x["ok"] else "UNKNOWN" if x["ok"] is None else "FAIL"
            why = "" if x["ok"] else f" ({', '.join(str(v) for v in x['error'].values() if v is not None)})"
            print(f"{name}: {said}{why}")
            if args.verbose and x.get("witness"):
                print(f"  witness: {x['witness']}")
    return int(failed)


def fmt(args: argparse.Namespace) -> int:
    files = [f for p in map(pathlib.Path, args.paths) for f in (sorted(p.rglob("*.hist")) if p.is_dir() else [p])]
    changed = 0
    for f in files:
        old = f.read_text()
        try:
            new = dsl.format_sessions(dsl.parse(old))
        except dsl.ParseError as e:
            print(f"{f}: {e}", file=sys.stderr)
            return 1
        if new != old:
            changed += 1
            print(f"{'would change' if args.check else 'formatted'}: {f}")
            if not args.check:
                f.write_text(new)
    return int(args.check and changed > 0)


def schema(args: argparse.Namespace) -> int:
    from .sources.json_files import json_schema

    print(json_schema())
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return {"generate": generate, "verify": verify, "fmt": fmt, "schema": schema}[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
