"""CSV and HTML reports."""

from __future__ import annotations

import html
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fmt
from ..operators.rollup import by_size

#: The columns of a CSV report.
CSV_COLUMNS = ["Name", "Full Path", "Type", "Size (Bytes)", "Size", "% of Total", "File Count", "Last Modified (UTC)"]


def _share(total: int | None) -> Column:
    """Basis points of a total; without one, of the row's own size."""
    return fmt.basis_points(F.col("size_bytes"), F.lit(total).cast("bigint") if total and total > 0 else F.col("size_bytes"))


def _csv_cells(total: int | None) -> list[Column]:
    stamp = F.coalesce(F.date_format("modified_utc", "yyyy-MM-dd HH:mm:ss'Z'"), F.lit(""))
    return [
        F.col("name"), F.col("full_path"), fmt.type_label(F.col("is_directory")), F.col("size_bytes").cast("string"), fmt.format_bytes(F.col("size_bytes")),
        fmt.percent_text(_share(total)), F.col("file_count").cast("string"), stamp,
    ]


def csv_rows(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """The cells of a CSV report as text, unquoted."""
    return nodes.select(*(c.alias(n) for c, n in zip(_csv_cells(total), CSV_COLUMNS)))


def csv_lines(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """One line of text per node, cells quoted only where they must be."""
    rows = csv_rows(nodes, total)
    return rows.select(F.concat_ws(",", *(fmt.csv_cell(F.col(f"`{c}`")) for c in CSV_COLUMNS)).alias("value"))


def write_csv(nodes: DataFrame, path: str, total: int | None = None) -> None:
    """A folder of CSV files with headers, by Spark's writer."""
    csv_rows(nodes, total).write.mode("overwrite").option("header", True).options(
        escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_lines(lines: DataFrame, order: list[Column], path: str, head: str = "", foot: str = "", joined: bool = True) -> None:
    """Lines of text in an order, which tasks sort and write: the lines are dealt by range, so that part files follow each
    other. The file system then joins head, parts and foot to one file, a buffer at a time; not joined, `path` is the
    folder of the parts. lines: value and what the order needs."""
    spark = lines.sparkSession
    parts = f"{path}.parts-{uuid.uuid4().hex}" if joined else path
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(parts)
    if not joined:
        return
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsparkSession.sessionState().newHadoopConf()
    folder, target = hadoop.fs.Path(parts), hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.setWriteChecksum(False)
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in sorted(f.getPath().getName() for f in fs.listStatus(folder)):
            if name.startswith("part-"):
                part = fs.open(hadoop.fs.Path(folder, name))
                try:
                    hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
        out.write(bytearray(foot.encode()))
    finally:
        out.close()
        fs.delete(folder, True)


def ordered_csv_lines(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """value, a line of a CSV report for each node, and traversal_ord, which gives the order."""
    return nodes.select(F.concat_ws(",", *(fmt.csv_cell(c) for c in _csv_cells(total))).alias("value"), "traversal_ord")


def write_csv_file(nodes: DataFrame, path: str, total: int | None = None, bom: bool = False) -> None:
    """One CSV file in the order of the walk."""
    write_lines(ordered_csv_lines(nodes, total), [F.col("traversal_ord")], path, "\ufeff" * bom + ",".join(CSV_COLUMNS) + "\n")


def html_rows(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """Escaped cells of an HTML report, the largest first when ordered by size. The total is that of all rows if not given."""
    if total is None:
        total = nodes.agg(F.sum("size_bytes")).first()[0]
    share = _share(total)
    return nodes.select(
        fmt.html_escape(F.col("name")).alias("name"), fmt.html_escape(F.col("full_path")).alias("full_path"), fmt.type_label(F.col("is_directory")).alias("kind"), "size_bytes",
        fmt.format_bytes(F.col("size_bytes")).alias("size_text"), fmt.percent_text(share, 1).alias("percent_text"), fmt.bar_width(share, 100).alias("bar_bp"), "file_count",
        fmt.modified_text(F.col("modified_utc")).alias("modified_text"), "is_directory", "traversal_ord",
    )


def html_lines(nodes: DataFrame, total: int | None = None) -> DataFrame:
    """value, a table row of an HTML report for each node, and size_bytes and traversal_ord, which give the order."""
    row = F.when(F.col("is_directory"), "<tr class='folder'>").otherwise("<tr>")
    bar = F.concat(F.lit("<div style='width:"), fmt.percent_text(F.col("bar_bp")), F.lit("%'></div>"), "percent_text", F.lit("%"))
    cells = [F.col("name"), F.col("full_path"), F.col("kind"), F.col("size_text"), bar, F.col("file_count").cast("string"), F.col("modified_text")]
    value = F.concat(row, *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    return html_rows(nodes, total).select(value.alias("value"), "size_bytes", "traversal_ord")


def write_html(nodes: DataFrame, path: str, title: str = "Scan report", total: int | None = None) -> None:
    """One HTML file, the largest node first."""
    count, text = nodes.count(), html.escape(title)
    head = f"<!DOCTYPE html>\n<html><head><meta charset='utf-8'><title>{text}</title><style>tr.folder td:first-child{{font-weight:bold}}</style></head>\n<body><h1>{text}</h1>\n<p>{count} items</p>\n<table>\n"
    head += "<tr><th>Name</th><th>Path</th><th>Type</th><th>Size</th><th>Share</th><th>Files</th><th>Last modified (UTC)</th></tr>\n"
    write_lines(html_lines(nodes, total), by_size(), path, head, "</table></body></html>\n")
