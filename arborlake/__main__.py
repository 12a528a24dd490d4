"""python -m arborlake --scan FOLDER [--export-csv FILE] [--export-html FILE] [--snapshot-save STORE] [--snapshot-json FILE] [--snapshot-compare STORE_OR_JSON_FILE] [--snapshot-id ID] [--quiet]

Exit codes: 0 done, 1 bad arguments or no baseline, 2 failed.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import functions as F

from .functions import fmt
from .operators import rollup, snapshot
from .session import local_session
from .sinks import export, snapshots
from .sources import fsnodes


def _arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="arborlake", exit_on_error=False)
    p.add_argument("--scan", required=True)
    for name in ("--export-csv", "--export-html", "--snapshot-save", "--snapshot-json", "--snapshot-compare"):
        p.add_argument(name)
    p.add_argument("--snapshot-id", default="baseline")
    p.add_argument("--quiet", action="store_true")
    found = p.parse_args(args)
    if not any((found.export_csv, found.export_html, found.snapshot_save, found.snapshot_json, found.snapshot_compare)):
        raise argparse.ArgumentError(None, "ask for an export or a snapshot")
    return found


def compare_report(before, after, say) -> None:
    """Counts, the net change, and the 20 largest entries of each kind, moves among them."""
    rest, moved = snapshot.compare(before, after)
    rest, moved = rest.persist(), moved.persist()
    n = rest.transform(snapshot.net_delta).withColumn("net", fmt.signed_bytes(F.col("net_delta_bytes"))).first()
    say(f"Added {n.added}, removed {n.removed}, changed {n.changed}, moved {moved.count()}; net change {n.net}")
    for kind in ("added", "removed", "changed"):
        for r in snapshot.change_texts(snapshot.top(rest, kind)).collect():
            say(f"  {kind}: {r.full_path} ({r.delta_text})")
    for r in moved.orderBy(*snapshot.order_of("moved")).limit(20).collect():
        say(f"  {r.move_kind.lower()}: {r.old_path} -> {r.new_path}")
    rest.unpersist()
    moved.unpersist()


def main(args: list[str] | None = None, spark=None) -> int:
    try:
        a = _arguments(sys.argv[1:] if args is None else args)
    except (argparse.ArgumentError, SystemExit) as e:
        print(f"{e}\n{__doc__}", file=sys.stderr)
        return 1
    say = (lambda *_: None) if a.quiet else print
    began = time.monotonic()
    try:
        spark = spark or local_session()
        nodes = fsnodes.scan(spark, a.scan).persist()
        totals = rollup.scan_totals(nodes).withColumn("line", fmt.totals_line(F.col("files"), F.col("total_bytes"))).first()
        say(f"{totals.line} in {fmt.elapsed_text(time.monotonic() - began)}")
        code = 0
        if a.export_csv:
            export.write_csv_file(nodes, a.export_csv, totals.total_bytes)
        if a.export_html:
            export.write_html(nodes, a.export_html, f"Scan of {a.scan}", totals.total_bytes)
        if a.snapshot_compare:
            if os.path.isdir(f"{a.snapshot_compare}/nodes/snapshot_id={a.snapshot_id}"):
                compare_report(snapshots.load(spark, a.snapshot_compare, a.snapshot_id), nodes, say)
            elif os.path.isfile(a.snapshot_compare):
                compare_report(snapshots.import_json(spark, a.snapshot_compare), nodes, say)
            else:
                print(f"no snapshot {a.snapshot_id} in {a.snapshot_compare}", file=sys.stderr)
                code = 1
        if a.snapshot_save:
            snapshots.save(nodes, a.snapshot_save, a.snapshot_id, root_path=os.path.abspath(a.scan))
        if a.snapshot_json:
            snapshots.write_json(nodes, os.path.abspath(a.snapshot_json), root_path=os.path.abspath(a.scan))
        nodes.unpersist()
        return code
    except Exception as e:  # the command line reports any failure by its exit code
        print(f"failed: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
