"""Scalar functions against golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake.functions import dhash, fmt, patterns, versions
from arborlake.functions import paths as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "size,text",
    [(0, "0 B"), (1, "1 B"), (999, "999 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"), (2**20, "1 MB"), (2**30, "1 GB"), (2**40, "1 TB"), (2**50, "1 PB"), (1474560, "1.41 MB"), (-1024, "-1 KB"), (-1, "-1 B"), (2**20 - 1, "1024 KB"), (2**60, "1024 PB"), (2**63 - 1, "8192 PB"), (-(2**63), "-8192 PB")],
)
def test_format_bytes(spark, size, text):
    assert one(spark, fmt.format_bytes(F.lit(size).cast("bigint"))) == text


def test_quotients_just_below_a_whole_number(spark):
    """Of large units and totals the quotient can be within a millionth of the next whole number and still below it."""
    sizes = [-(-(h * 2 - 1) * unit // 200) + d for unit in (2**30, 2**40, 2**50) for h in (101, 1097, 99803) for d in (-1, 0)]
    sizes = [n for n in sizes if n < 2**63]

    def text(n):
        k = max(k for k in range(6) if n >= 1024**k)
        whole, rest = divmod((n * 200 + 1024**k) // (2 * 1024**k), 100)
        return f"{whole}" + (f".{rest:02d}".rstrip("0") if rest else "") + f" {fmt.UNITS[k]}"

    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select("n", fmt.format_bytes(F.col("n")).alias("text"))
    assert {r.n: r.text for r in rows.collect()} == {n: text(n) for n in sizes}
    total = 10**15 + 7
    parts = [-(-(h * 2 - 1) * total // 20000) + d for h in (1, 4999, 9999) for d in (-1, 0)]
    rows = spark.createDataFrame([(n,) for n in parts], "n bigint").select("n", fmt.basis_points(F.col("n"), F.lit(total).cast("bigint")).alias("bp"))
    assert {r.n: r.bp for r in rows.collect()} == {n: (n * 20000 + total) // (2 * total) for n in parts}


def test_changes_and_cells(spark):
    big = lambda x: F.lit(x).cast("bigint")
    assert one(spark, fmt.signed_bytes(big(0))) == "+0 B"
    assert one(spark, fmt.signed_bytes(big(-2048))) == "-2 KB"
    assert one(spark, fmt.size_change(big(0), big(5))) == "5 B"
    assert one(spark, fmt.size_change(big(5), big(0))) == "5 B"
    assert one(spark, fmt.size_change(big(1), big(2))) == "1 B → 2 B"
    assert one(spark, fmt.pad_counter(big(1234), 2)) == "1234"
    assert one(spark, fmt.pad_counter(big(7), 4)) == "0007"
    assert one(spark, fmt.csv_cell(F.lit('a"b,c'))) == '"a""b,c"'
    assert one(spark, fmt.csv_cell(F.lit(" plain "))) == " plain "
    assert one(spark, fmt.html_escape(F.lit("<a&b\"'>"))) == "&lt;a&amp;b&quot;'&gt;"
    assert one(spark, fmt.modified_text(F.lit(None).cast("timestamp"))) == "—"
    assert one(spark, fmt.basis_points(big(1), big(0))) == 0
    assert [fmt.elapsed_text(x) for x in (0.2, 5.9, 61)] == ["<1s", "5s", "1m 1s"]
    assert fmt.parse_megabytes(" 1.5 ") == 1572864 and fmt.parse_megabytes("") is None
    for bad in ("-1", "x"):
        with pytest.raises(ValueError):
            fmt.parse_megabytes(bad)


@pytest.mark.parametrize("name,base,ext", [("a.txt", "a", ".txt"), (".gitignore", "", ".gitignore"), ("x", "x", ""), ("dot.", "dot", ""), ("a.b.c", "a.b", ".c")])
def test_name_parts(spark, name, base, ext):
    assert one(spark, P.base_of(F.lit(name))) == base
    assert one(spark, P.extension_of(F.lit(name))) == ext


def test_paths(spark):
    assert one(spark, P.ancestors_of(F.lit("/a/b/c"))) == ["/", "/a", "/a/b"]
    assert one(spark, P.ancestors_of(F.lit("/"))) == []
    assert one(spark, P.parent_of(F.lit("/a"))) == "/" and one(spark, P.parent_of(F.lit("/"))) is None
    rows = [("/", True), ("/b", True), ("/b/x", False), ("/b/a", True), ("/b/a/y", False), ("/z", False), ("/a.txt", False), ("/ba", True)]
    df = spark.createDataFrame(rows, "p string, d boolean").orderBy(P.traversal_key(F.col("p"), F.col("d")))
    assert [r.p for r in df.collect()] == ["/", "/a.txt", "/z", "/b", "/b/x", "/b/a", "/b/a/y", "/ba"]


def test_patterns(spark):
    hits = lambda name, pattern, regex=False: one(spark, F.lit(name).rlike(patterns.name_pattern(pattern, regex)))
    assert hits("Report.PDF", "*.pdf") and not hits("Report.PDFx", "*.pdf")
    assert hits("a+b.txt", "a+b.t?t") and not hits("aab.txt", "a+b.t?t")
    assert hits("ÉTÉ.txt", "été*") and hits("xx12", r"\d\d", True)
    for bad in ("(", r"(?<a-b>x)"):
        with pytest.raises(ValueError):
            patterns.check(bad)
    swap = lambda text, pattern, new: one(spark, F.regexp_replace(F.lit(text), pattern, F.lit(patterns.replacement(new, pattern))))
    assert swap("ab", "(a)(b)", "$2$1") == "ba"
    assert swap("ab", "a", "[$&]") == "[a]b"
    assert swap("ab", "a", "$$3") == "$3b"
    assert swap("ab", "a", "$3\\") == "$3\\b"


def test_difference_hash(spark):
    falling, rising = np.tile(np.arange(9)[::-1], (8, 1)), np.tile(np.arange(9), (8, 1))
    assert dhash.grid_hash(falling) == -1 and dhash.grid_hash(rising) == 0 and dhash.grid_hash(np.ones((8, 9))) == 0
    rng = np.random.default_rng(1)
    for _ in range(5):
        grid = rng.integers(0, 256, (8, 9))
        assert one(spark, dhash.grid_hash_column(F.array(*(F.lit(int(v)) for v in grid.ravel())))) == dhash.grid_hash(grid)
    big = rng.integers(0, 256, (4, 5)).repeat(40, 0).repeat(40, 1)
    pgm = lambda a: b"P5\n# c\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()
    noisy = np.clip(big + rng.integers(-3, 4, big.shape), 0, 255)
    rows = spark.createDataFrame([(0, bytearray(pgm(big))), (1, bytearray(pgm(noisy))), (2, bytearray(b"no image")), (3, None)], "i int, content binary")
    h = {r.i: r.h for r in rows.select("i", dhash.image_hash("content").alias("h")).collect()}
    assert h[2] is None and h[3] is None
    assert bin((h[0] ^ h[1]) & (2**64 - 1)).count("1") <= 10


def test_manifests_and_versions(spark):
    field = lambda xml: one(spark, versions.manifest_fields(F.lit(xml)))
    ok = field("<appinfo><version> 1.5 </version><url> u </url><about>a</about></appinfo>")
    assert (ok.version, ok.url, ok.about, ok.error) == ("1.5", "u", "a", None)
    assert field("<appinfo><url>u</url></appinfo>").error == "no version"
    assert field("<appinfo><version>1.0</version></appinfo>").error == "no url"
    assert field("<other/>").error == "no appinfo element"
    assert field("<appinfo><version>x</version><url>u</url></appinfo>").error == "not a version"
    assert one(spark, versions.rights_label(F.lit(0x1F01FF))) == "Full control"
    assert one(spark, versions.rights_label(F.lit(0x20089))) == "Read"
    assert one(spark, versions.rights_label(F.lit(1))) == "ReadData"
    assert one(spark, versions.rights_label(F.lit(0x10021))) == "ReadData, ExecuteFile, Delete"
    assert one(spark, versions.rights_label(F.lit(0x201001))) == "2101249" and one(spark, versions.rights_label(F.lit(0))) == "0"
    assert field("<appinfo><version>x</version></appinfo>").error == "not a version"
    for xml, want in MANIFESTS:
        assert tuple(field(xml)) == want
    for offered, running, newer in VERSIONS:
        assert one(spark, versions.is_newer(F.lit(offered), F.lit(running))) == newer
    for mask, label in RIGHTS:
        assert one(spark, versions.rights_label(F.lit(mask))) == label


RIGHTS = [(0x1F01FF, "Full control"), (0x301BF, "Modify"), (0x201BF, "Read & execute, Write"), (0x200A9, "Read & execute"), (0x2019F, "Read, Write"), (0x20089, "Read"), (0x116, "Write")]
VERSIONS = [("2.0.0.0", "1.0.0.0", True), ("1.0", "1.0.0.0", False), ("0.9", "1.0", False), ("1.4.0", "1.4.0.0", False), ("1.5", "1.4.0.0", True), ("1", "0.9", False), ("x.y", "1.0", False)]
MANIFESTS = [
    ("<appinfo><version> 1.5 </version><url>https://a.example</url><about/></appinfo>", ("1.5", "https://a.example", None, None)),
    ("<appinfo><version>1.0</version><url>u</url><about> text </about></appinfo>", ("1.0", "u", "text", None)),
    ("<appinfo><url>u</url></appinfo>", (None, "u", None, "no version")),
    ("<appinfo><version>1.0</version></appinfo>", ("1.0", None, None, "no url")),
    ("<appinfo><version>x</version><url>u</url></appinfo>", ("x", "u", None, "not a version")),
    ("<other/>", (None, None, None, "no appinfo element")),
    ("not xml", (None, None, None, "not well-formed")),
    ("<appinfo><version>1.0</version><url>u", (None, None, None, "not well-formed")),
    ("<appinfo><version>1.0</url></appinfo>", (None, None, None, "not well-formed")),
    ("<appinfo/><appinfo/>", (None, None, None, "not well-formed")),
    ("", (None, None, None, "not well-formed")),
]
