"""Parts of paths as column expressions. The separator is `/`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(path: Column) -> Column:
    """What follows the last separator; the root is named by its whole path."""
    return F.when(path == "/", path).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def parent_of(path: Column) -> Column:
    """The path of the folder; null for the root."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(path == "/", F.lit(None)).when(up == "", "/").otherwise(up)


def extension_of(name: Column) -> Column:
    """From the last dot on; empty if there is none or it is the last character."""
    return F.regexp_extract(name, r"(\.[^.]+)$", 1)


def base_of(name: Column) -> Column:
    """Up to the last dot; `.gitignore` has an empty one."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"(?s)^(.*)\.[^.]*$", 1)).otherwise(name)


def combine(folder: Column, name: Column) -> Column:
    return F.when(folder == "/", F.concat(F.lit("/"), name)).otherwise(F.concat_ws("/", folder, name))


def depth_of(path: Column) -> Column:
    return F.when(path == "/", 0).otherwise(F.size(F.split(path, "/")) - 1).cast("int")


def ancestors_of(path: Column) -> Column:
    """The folders above a path, the root first; empty for the root."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, "/").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(path == "/", F.expr("cast(array() AS array<string>)")).otherwise(above)


def traversal_key(path: Column, is_directory: Column) -> Column:
    """Sorts as a depth-first walk that visits a folder's files before its sub-folders."""
    steps = F.replace(F.substring(path, F.lit(2), F.length(path)), F.lit("/"), F.lit("\u0002"))
    last = F.regexp_extract(steps, "^(?s)(.*\u0002)?([^\u0002]*)$", 2)
    above = F.substring(steps, F.lit(1), F.length(steps) - F.length(last))
    file_key = F.concat(F.lit("\u0002"), above)
    file_key = F.concat(F.substring(file_key, F.lit(1), F.length(file_key) - 1), F.lit("\u0001"), last)
    return F.when(path == "/", "").when(is_directory, F.concat(F.lit("\u0002"), steps)).otherwise(file_key)
