"""Owners and rights of files on POSIX systems, in the shape of access rules.

Windows access lists cannot be read here; `acl_order` and `rights_label` in functions/versions.py work on
rules from anywhere.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql import DataFrame

from ..plans.workers import ready

SCHEMA = "full_path string, owner string, identity string, rights string, inherited boolean, deny boolean"

#: Names of the three bits of a class of users.
_RIGHTS = {7: "Full control", 6: "Read & write", 5: "Read & execute", 4: "Read", 3: "Write & execute", 2: "Write", 1: "Execute", 0: "None"}


def rules_of(path: str) -> list[tuple]:
    """The rules for owner, group and others; none if the file cannot be read."""
    import grp
    import pwd

    try:
        s = os.stat(path)
    except OSError:
        return []

    def name(find, number):
        try:
            return find(number)[0]
        except KeyError:
            return str(number)

    owner, mode = name(pwd.getpwuid, s.st_uid), stat.S_IMODE(s.st_mode)
    who = (owner, name(grp.getgrgid, s.st_gid), "others")
    return [(path, owner, identity, _RIGHTS[mode >> shift & 7], False, False) for identity, shift in zip(who, (6, 3, 0))]


def permissions(files: DataFrame) -> DataFrame:
    """The rules of every full_path, read by the tasks."""
    import pandas as pd

    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame([r for p in pdf["full_path"] for r in rules_of(p)], columns=columns)

    return ready(files.select("full_path")).mapInPandas(read, SCHEMA)
