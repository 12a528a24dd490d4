"""Deleting: a plan by default; execution is opt-in and on the driver's own file system."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame


def delete(plan: DataFrame, really: bool = False) -> tuple[list[str], list[tuple[str, str]]]:
    """Deletes the plan's paths for good; needs really=True. Returns paths, and (path, error) of failures."""
    if not really:
        raise ValueError("deleting is opt-in: pass really=True")
    deleted, failed = [], []
    for r in plan.select("full_path").distinct().toLocalIterator():
        try:
            if os.path.isdir(r.full_path) and not os.path.islink(r.full_path):
                shutil.rmtree(r.full_path)
            else:
                os.remove(r.full_path)
            deleted.append(r.full_path)
        except OSError as e:
            failed.append((r.full_path, str(e)))
    return deleted, failed
