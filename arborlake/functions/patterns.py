"""Name patterns and replacement texts in the search dialect, as Java regular expressions."""

from __future__ import annotations

import re

#: Ignore case over all of Unicode; only a line feed ends a line.
PREFIX = "(?iud)"

_UNSUPPORTED = [(r"\(\?<[^=!>]+-[^>]*>", "balancing groups"), (r"\(\?\(", "conditional groups")]


def wildcard(pattern: str) -> str:
    """`*` is any text, `?` any character; the whole name has to fit."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def check(pattern: str) -> str:
    """The pattern, if the engine can run it; ValueError otherwise."""
    for sign, what in _UNSUPPORTED:
        if re.search(sign, pattern):
            raise ValueError(f"{what} are not supported: {pattern!r}")
    try:  # Python's syntax is near enough to find unbalanced patterns before a job starts
        re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", re.sub(r"\\[pP]\{[^}]*\}", "x", pattern)))
    except re.error as e:
        raise ValueError(f"bad pattern {pattern!r}: {e}") from None
    return pattern


def name_pattern(text: str, is_regex: bool) -> str:
    return PREFIX + (check(text) if is_regex else wildcard(text))


def groups_in(pattern: str) -> int:
    """Number of capture groups."""
    plain = re.sub(r"\\.", "", re.sub(r"\[(?:\\.|[^\]\\])*\]", "", pattern))
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def replacement(text: str, pattern: str) -> str:
    """A replacement text for the engine: `$1` and `$&` work, `$$` is a dollar sign, and what names no group stands for itself."""
    n = groups_in(pattern)
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            out.append("\\\\")
        elif c != "$":
            out.append(c)
        elif text[i + 1 : i + 2] == "$":
            out.append("\\$")
            i += 1
        elif text[i + 1 : i + 2] == "&":
            out.append("$0")
            i += 1
        elif (m := re.match(r"\$(\d+)|\$\{(\d+)\}", text[i:])) and int(m[1] or m[2]) <= n:
            out.append(f"${m[1] or m[2]}")
            rest = text[i + len(m[0]) : i + len(m[0]) + 1]
            if rest.isdigit():  # a digit that follows is text
                out.append("\\" + rest)
                i += 1
            i += len(m[0]) - 1
        elif m := re.match(r"\$\{([A-Za-z]\w*)\}", text[i:]):
            out.append("${%s}" % m[1] if f"(?<{m[1]}>" in pattern else "\\" + m[0].replace("{", "\\{"))
            i += len(m[0]) - 1
        else:
            out.append("\\$")
        i += 1
    return "".join(out)
