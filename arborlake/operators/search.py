"""Search: criteria become one predicate that the scan of the table can prune by."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..functions.patterns import name_pattern
from ..schema import modified_or_unknown
from .rollup import by_size


@dataclass(frozen=True)
class SearchCriteria:
    """All criteria that are set have to hold. Sizes and times are inclusive."""

    name_pattern: str | None = None
    is_regex: bool = False
    min_size: int | None = None
    max_size: int | None = None
    modified_after: datetime | str | None = None
    modified_before: datetime | str | None = None
    extensions: list[str] = field(default_factory=list)
    include_files: bool = True
    include_directories: bool = True

    @property
    def is_empty(self) -> bool:
        bounds = (self.min_size, self.max_size, self.modified_after, self.modified_before)
        return not (self.name_pattern or "").strip() and all(x is None for x in bounds) and not normalized(self.extensions)

    def validate(self) -> SearchCriteria:
        """Itself; ValueError if it asks for no kind, a negative size, or a minimum above the maximum."""
        if not (self.include_files or self.include_directories):
            raise ValueError("choose files, folders or both")
        if any(x is not None and x < 0 for x in (self.min_size, self.max_size)):
            raise ValueError("a size cannot be negative")
        if self.min_size is not None and self.max_size is not None and self.min_size > self.max_size:
            raise ValueError("the minimum size is above the maximum")
        return self

    def predicate(self) -> Column:
        self.validate()
        tests = []
        if not self.include_files:
            tests.append(F.col("is_directory"))
        if not self.include_directories:
            tests.append(~F.col("is_directory"))
        if (self.name_pattern or "").strip():
            tests.append(F.col("name").rlike(name_pattern(self.name_pattern, self.is_regex)))
        if self.min_size is not None:
            tests.append(F.col("size_bytes") >= self.min_size)
        if self.max_size is not None:
            tests.append(F.col("size_bytes") <= self.max_size)
        if self.modified_after is not None:
            tests.append(modified_or_unknown(F.col("modified_utc")) >= F.lit(self.modified_after).cast("timestamp"))
        if self.modified_before is not None:
            tests.append(modified_or_unknown(F.col("modified_utc")) <= F.lit(self.modified_before).cast("timestamp"))
        if own := normalized(self.extensions):  # folders are not held against extensions
            tests.append(F.col("is_directory") | F.lower("extension").isin([x.lower() for x in own]))
        return reduce(lambda a, b: a & b, tests, F.lit(True))


def normalized(extensions: list[str]) -> list[str]:
    """Blanks dropped, a leading dot added."""
    return [x if x.startswith(".") else f".{x}" for x in (e.strip() for e in extensions or []) if x]


def criteria_from_text(min_mb: str | None = None, max_mb: str | None = None, extensions: str | None = None, **more) -> SearchCriteria:
    """Criteria as typed: sizes in megabytes, extensions parted by commas, semicolons or blanks."""
    parts = (extensions or "").replace(";", ",").replace(" ", ",").split(",")
    return SearchCriteria(min_size=fmt.parse_megabytes(min_mb), max_size=fmt.parse_megabytes(max_mb), extensions=parts, **more).validate()


def search(nodes: DataFrame, criteria: SearchCriteria) -> DataFrame:
    """The nodes that fit; the root is a candidate."""
    return nodes.where(criteria.predicate())


def ranked(hits: DataFrame) -> DataFrame:
    """Largest first."""
    return hits.orderBy(*by_size())


def without(results: DataFrame, gone: DataFrame) -> DataFrame:
    """Results that are not among these paths."""
    return results.join(gone.select("full_path").distinct(), "full_path", "left_anti")
