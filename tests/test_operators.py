"""Operators against brute force, fixtures and properties."""

import itertools
import json
import os
import random
from datetime import datetime, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlake import __main__ as cli
from arborlake.functions import paths as P
from arborlake.operators import cleanup, duplicates, rename, rollup, search, similar, snapshot, treemap
from arborlake.operators.components import components
from arborlake.plans.numbering import number_rows, rank_within
from arborlake.plans.scratch import Scratch
from arborlake.schema import NODES
from arborlake.sinks import export, snapshots
from arborlake.sources import fsnodes
from arborlake.streaming import progress


def leaves(spark, files):
    return spark.createDataFrame([(p, s, None) for p, s in files.items()], "full_path string, size_bytes bigint, modified_utc timestamp")


def nodes_of(spark, files, folders=()):
    return rollup.build_nodes(leaves(spark, files), spark.createDataFrame([(f,) for f in folders], "full_path string") if folders else None)


def table(df):
    return {r.full_path: (r.size_bytes, r.file_count, r.is_directory) for r in df.collect()}


def random_files(seed, n=60):
    rng = random.Random(seed)
    return {"/" + "/".join(rng.choice("abc") + str(rng.randrange(2)) for _ in range(rng.randrange(0, 5))) + f"/f{i}.txt".replace("//", "/"): rng.randrange(0, 50) for i in range(n)}


def test_rollup(spark):
    deep = "/" + "/".join("d" * 1 for _ in range(30)) + "/f"
    files = {"/a/x": 5, "/a/b/y": 7, "/zero": 0, deep: 3}
    got = table(nodes_of(spark, files, ["/empty/below"]))
    assert got["/"] == (15, 4, True) and got["/a"] == (12, 2, True) and got["/empty"] == (0, 0, True) and got["/empty/below"] == (0, 0, True)
    assert got["/zero"] == (0, 1, False) and len(got) == 4 + 1 + 2 + 2 + 30


@pytest.mark.parametrize("seed", [1, 2])
def test_children_add_up_and_patches_equal_a_recompute(spark, seed):
    files = {p.replace("//", "/"): s for p, s in random_files(seed).items()}
    nodes = nodes_of(spark, files).persist()
    got = table(nodes)
    for path, (size, count, is_dir) in got.items():
        if is_dir:
            kids = [v for q, v in got.items() if q != "/" and (q.rsplit("/", 1)[0] or "/") == path]
            assert (size, count) == (sum(k[0] for k in kids), sum(k[1] for k in kids))
    rng = random.Random(seed)
    gone = rng.sample(sorted(p for p in got if p != "/"), 8)
    paths = spark.createDataFrame([(p,) for p in [*gone, gone[0], "/", "/unknown"]], "full_path string")
    left = {p: s for p, s in files.items() if not any(p == g or p.startswith(g + "/") for g in gone)}
    folders = [p for p, v in got.items() if v[2] and p != "/" and not any(p == g or p.startswith(g + "/") for g in gone)]
    assert table(rollup.remove_nodes(nodes, paths)) == table(nodes_of(spark, left, folders or ["/"]))


def test_search(spark):
    rows = [("/", True, 100, None), ("/É.TXT", False, 5, None), ("/a.b+c.txt", False, 9, datetime(2024, 1, 2)), ("/d", True, 50, None), ("/d/x.md", False, 50, datetime(2020, 1, 1))]
    df = spark.createDataFrame(rows, "full_path string, is_directory boolean, size_bytes bigint, modified_utc timestamp")
    df = df.withColumn("name", P.name_of(F.col("full_path"))).withColumn("extension", F.when(~F.col("is_directory"), P.extension_of(F.col("name"))))
    find = lambda **k: {r.full_path for r in search.search(df, search.SearchCriteria(**k)).collect()}
    assert find() == {r[0] for r in rows}
    assert find(name_pattern="é*") == {"/É.TXT"}
    assert find(name_pattern="a.b+c.*") == {"/a.b+c.txt"}
    assert find(extensions=["txt", " "]) == {"/", "/d", "/É.TXT", "/a.b+c.txt"}
    assert find(extensions=["", " "]) == {r[0] for r in rows}
    assert find(modified_after=datetime(2023, 1, 1)) == {"/a.b+c.txt"}
    assert find(modified_before=datetime(2020, 1, 1)) == {"/", "/d", "/É.TXT", "/d/x.md"}
    assert find(min_size=50, max_size=100, include_files=False) == {"/", "/d"}
    assert search.SearchCriteria().is_empty and search.SearchCriteria(name_pattern=" ", extensions=[""]).is_empty
    for bad in (dict(include_files=False, include_directories=False), dict(min_size=-1), dict(min_size=2, max_size=1), dict(name_pattern="(", is_regex=True)):
        with pytest.raises(ValueError):
            search.SearchCriteria(**bad).predicate()


def test_duplicates(spark):
    head = b"h" * 4096
    t = datetime(2024, 1, 1)
    rows = [("/0a", b"", t), ("/0b", b"", t), ("/a", b"xx", t), ("/b", b"yy", t), ("/c1", head + b"1", t), ("/c2", head + b"2", t), ("/c3", head + b"1", t), ("/n", None, t), ("/e2", b"same!", t), ("/e1", b"same!", t), ("/e0", b"same!", None)]
    df = spark.createDataFrame([(p, len(c) if c is not None else 5, m, bytearray(c) if c is not None else None) for p, c, m in rows], "full_path string, size_bytes bigint, modified_utc timestamp, content binary")
    found = duplicates.duplicate_files(df).persist()
    assert {r.full_path for r in found.collect()} == {"/c1", "/c3", "/e0", "/e1", "/e2"}
    plan = duplicates.keep_plan(found)
    assert {r.full_path: r.rank for r in plan.collect()} == {"/c1": 1, "/c3": 2, "/e0": 1, "/e1": 2, "/e2": 3}
    assert {r.full_path for r in duplicates.delete_plan(plan).collect()} == {"/c3", "/e1", "/e2"}
    with pytest.raises(ValueError):
        duplicates.delete_plan(plan.withColumn("selected", F.lit(True)))
    left = duplicates.after_delete(found, spark.createDataFrame([("/E1",), ("/c1",)], "full_path string"))
    assert {(r.full_path, r.copies) for r in left.collect()} == {("/e0", 2), ("/e2", 2)}
    assert duplicates.duplicate_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 5, 10, 20, 64])
def test_hash_pairs(spark, distance):
    rng = random.Random(distance)
    hashes = [0, 2**63 - 1, -(2**63), -1]
    for _ in range(80):
        h = rng.choice(hashes) & (2**64 - 1)
        for _ in range(rng.randrange(0, distance + 3)):
            h ^= 1 << rng.randrange(64)
        hashes.append(h - 2**64 if h >= 2**63 else h)
    hashes = sorted(set(hashes))
    want = {(a, b) for a, b in itertools.combinations(hashes, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
    assert {tuple(r) for r in similar.hash_pairs(spark.createDataFrame([(h,) for h in hashes + hashes[:5]], "hash bigint"), distance).collect()} == want


def test_similar_chain(spark):
    rows = [("/B.png", 10, 0), ("/a.png", 10, 0b111), ("/c.png", 30, 0b111111), ("/far.png", 5, -1), ("/null.png", 5, None)]
    got = similar.similar_groups(spark.createDataFrame(rows, "full_path string, size_bytes bigint, hash bigint"), 3)
    assert {(r.full_path, r.rank) for r in got.collect()} == {("/c.png", 1), ("/a.png", 2), ("/B.png", 3)}
    assert similar.group_waste(got).first().wasted_bytes == 20
    with pytest.raises(ValueError):
        similar.hash_pairs(got, 65)


@pytest.mark.parametrize("distance,few,block,shard", [(20, 0, 50, 40), (20, 0, 7, 8), (20, 0, 8000, 2000), (23, 0, 16, 60), (6, 1000, 9, 30), (6, 0, 9, 30), (64, 0, 16, 20), (0, 1000, 16, 20)])
def test_hash_groups_against_brute_force(spark, distance, few, block, shard):
    """Components from links within shards and from what is outside of the largest component are those of all pairs."""
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(200)]
    for h in hashes[:30]:  # chains off the rest
        for _ in range(3):
            for i in rng.sample(range(64), 5):
                h ^= 1 << i
            hashes.append(h)
    hashes = sorted({h - (1 << 63) for h in hashes})
    near = {a: [b for b in hashes if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance] for a in hashes}
    want, seen = {}, set()
    for a in hashes:
        front = [a] if near[a] and a not in seen else []
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                want[x] = a
                front += near[x]
    rows = spark.createDataFrame([(h,) for h in [*hashes, *hashes[:5], None]], "hash bigint")
    found = similar.hash_groups(rows, distance, None, few, block, shard).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == set(want.items())


def test_hash_groups_compare_few_pairs(spark, monkeypatch):
    """Where one component holds nearly all hashes, no comparison of all with all is made."""
    monkeypatch.setattr(similar, "hash_pairs", lambda *a, **k: pytest.fail("all pairs"))
    compared = spark.sparkContext.accumulator(0)
    met = similar._met
    monkeypatch.setattr(similar, "_met", lambda rows, inner, blocks, *a: (compared.add(inner * blocks), met(rows, inner, blocks, *a))[1])
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.getrandbits(64) - (1 << 63),) for _ in range(6000)], "hash bigint")
    found = similar.hash_groups(rows, 22, None, 0, 500, 1000)
    assert found.select("component").distinct().count() == 1 and found.count() > 5990
    assert compared.value <= 14  # of 78 pairs of blocks


def test_bands_and_chains_broadcast_no_table(spark, monkeypatch):
    """A table whose file or source is small may be large once it is read or exploded."""
    plans, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (plans.append(df), keep(self, df, name))[1])
    for distance in (8, 10):
        plans.append(similar.hash_pairs(spark.range(500).selectExpr("xxhash64(id) AS hash"), distance, 0))
    rows = spark.range(200).selectExpr("concat('/', id) AS full_path", "concat(id + 1, '') AS new_name", "concat('/', id + 1) AS new_path", "id AS ord", "CAST(NULL AS STRING) AS error")
    plans.append(rename.chains(rows))
    assert len(plans) > 6
    for df in plans:
        if not hasattr(df, "_scratch_path"):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_image_pairs_by_blocks_and_bands(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = [(f"/{k}-{j}", (h ^ (1 << j) ^ (1 << 3 * j)) - (1 << 63)) for k, h in enumerate(base) for j in range(6)]
    images = spark.createDataFrame([*rows, ("/z", rows[0][1]), ("/null", None)], "full_path string, hash bigint")
    first = {}
    for p, h in sorted([*rows, ("/z", rows[0][1])]):
        first.setdefault(h, p)
    bits = lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1")
    for distance in (4, 10, 20):
        want = sorted((*sorted((first[a], first[b])), bits(a, b)) for a, b in itertools.combinations(first, 2) if bits(a, b) <= distance)
        for few in (0, 1000):
            assert sorted(tuple(r) for r in similar.image_pairs(images, distance, few).collect()) == want


@pytest.mark.parametrize("distance", [3, 8, 9, 10, 11, 12])
def test_hash_pairs_against_brute_force(spark, distance):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        for _ in range(3):
            x = h
            for i in rng.sample(range(64), rng.randrange(1, 14)):
                x ^= 1 << i
            hashes.append(x)
    hashes = [h - (1 << 63) for h in hashes]
    found = similar.hash_pairs(spark.createDataFrame([(h,) for h in hashes + hashes[:5]], "hash bigint"), distance)
    want = {(min(a, b), max(a, b)) for a in hashes for b in hashes if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= distance}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    for few, block in ((0, 2000), (0, 7), (1000, 16)):  # by bands, in small blocks, in blocks of one bucket
        again = similar.hash_pairs(spark.createDataFrame([(h,) for h in hashes + hashes[:5]], "hash bigint"), distance, few, block)
        assert {tuple(r) for r in again.collect()} == want and again.count() == len(want)
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_duplicates_on_disk(spark, tmp_path):
    from arborlake.sources import fsnodes

    big = bytes(range(256)) * 5000
    for name, data in {"a": big, "b": big, "c": big[:-1] + b"x", "d": b"x" + big[1:], "sub/e": b"12", "sub/f": b"12", "g": b"", "h": b"", "i": b"34", "j": b"5"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    nodes = fsnodes.scan(spark, str(tmp_path))
    got = {r.full_path: (r.size_bytes, r.copies) for r in fsnodes.duplicates(nodes.where("NOT is_directory"), str(tmp_path)).collect()}
    assert got == {"/a": (len(big), 2), "/b": (len(big), 2), "/sub/e": (2, 2), "/sub/f": (2, 2)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 340)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges + [(5, None)], "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def greedy_moves(removed, added):
    """First-in first-out pairing by name, size and kind, then by extension and size."""
    pairs, left_a = [], list(added)
    left_r = []
    for r in removed:
        hit = next((a for a in left_a if (a[1], a[2], a[3]) == (r[1], r[2], r[3])), None)
        if hit:
            left_a.remove(hit)
            pairs.append((r[0], hit[0]))
        else:
            left_r.append(r)
    for r in left_r:
        hit = next((a for a in left_a if not r[3] and not a[3] and r[2] > 0 and (a[4], a[2]) == (r[4], r[2])), None)
        if hit:
            left_a.remove(hit)
            pairs.append((r[0], hit[0]))
    return set(pairs)


@pytest.mark.parametrize("seed", [1, 2])
def test_moves_are_greedy(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"/{k[0]}/{i}/" + (name := rng.choice(["x.a", "y.a", "z.b"])), name, rng.random() < 0.2, name[1:], f"{i:04}", rng.randrange(0, 3)) for i, k in enumerate(rng.choices(["added", "removed"], k=60))]
    diff = spark.createDataFrame([(k, p, n, d, e, t, 0 if k == "added" else s, s if k == "added" else 0) for k, p, n, d, e, t, s in rows], "kind string, full_path string, name string, is_directory boolean, extension string, traversal_ord string, old_bytes bigint, new_bytes bigint")
    side = lambda kind: [(p, n, s, d, e) for k, p, n, d, e, t, s in rows if k == kind]
    assert {(r.old_path, r.new_path) for r in snapshot.moves(diff).collect()} == greedy_moves(side("removed"), side("added"))


def test_compare(spark):
    before = nodes_of(spark, {"/A/keep": 1, "/A/grow": 5, "/gone/f.txt": 10, "/old/name.txt": 7, "/old/zero1": 0})
    after = nodes_of(spark, {"/a/KEEP": 1, "/A/grow": 8, "/d/new": 4, "/old/other.txt": 7, "/old/zero2": 0, "/back/f.txt": 10})
    rest, moved = snapshot.compare(before, after)
    assert {(r.old_path, r.new_path, r.move_kind) for r in moved.collect() if not r.is_directory} == {("/gone/f.txt", "/back/f.txt", "Moved"), ("/old/name.txt", "/old/other.txt", "Renamed")}
    kinds = {(r.kind, r.full_path) for r in rest.collect()}
    assert ("changed", "/A/grow") in kinds and ("added", "/d/new") in kinds and ("removed", "/old/zero1") in kinds and ("added", "/old/zero2") in kinds
    assert not any(p.lower() == "/a/keep" for _, p in kinds)
    n = snapshot.net_delta(rest).first()
    assert n.net_delta_bytes == 7 and n.net_delta_reference != 7
    assert snapshot.changes(before, before).count() == 0


RENAMES = [
    (["/holiday.jpg"], dict(prefix="2026-", suffix="-edited"), ["2026-holiday-edited.jpg"], [None]),
    (["/DSC_0001.jpg"], dict(find="DSC_", replace="Photo "), ["Photo 0001.jpg"], [None]),
    (["/report-2024-final.pdf"], dict(find=r"\d{4}", is_regex=True, replace="YYYY"), ["report-YYYY-final.pdf"], [None]),
    (["/abc.txt"], dict(find=".", replace="!"), ["abc.txt"], [None]),
    (["/a.txt", "/b.txt", "/c.txt"], dict(use_counter=True), ["a01.txt", "b02.txt", "c03.txt"], [None] * 3),
    (["/a.txt", "/b.txt"], dict(use_counter=True, counter_start=5, counter_step=10, counter_digits=4), ["a0005.txt", "b0015.txt"], [None] * 2),
    (["/abc.txt"], dict(find="abc"), [".txt"], [rename.EMPTY]),
    (["/file1.txt", "/file2.txt"], dict(find=r"\d", is_regex=True), ["file.txt", "file.txt"], [None, rename.COLLIDES]),
    (["/abc.txt", "/keep.txt"], dict(find="abc"), [".txt", "keep.txt"], [rename.EMPTY, None]),
]


@pytest.mark.parametrize("files,options,names,errors", RENAMES)
def test_rename(spark, files, options, names, errors):
    batch = spark.createDataFrame([(p, i) for i, p in enumerate(files)], "full_path string, ord bigint")
    got = rename.preview(batch, rename.RenameOptions(**options)).orderBy("ord").collect()
    assert [r.new_name for r in got] == names and [r.error for r in got] == errors


def test_rename_applies(spark, tmp_path):
    for n in ("a1.txt", "a2.txt", "keep.txt"):
        (tmp_path / n).write_text(n)
    batch = spark.createDataFrame([(str(tmp_path / n), i) for i, n in enumerate(("a1.txt", "a2.txt", "keep.txt"))], "full_path string, ord bigint")
    rows = rename.preview(batch, rename.RenameOptions(find=r"\d", is_regex=True))
    with pytest.raises(ValueError):
        rename.apply(rows)
    done, failed = rename.apply(rows, really=True)
    assert [os.path.basename(x) for x in done] == ["a.txt"] and failed[0][1] == rename.COLLIDES
    gone, lost = cleanup.delete(spark.createDataFrame([(str(tmp_path / "a.txt"),), (str(tmp_path / "none"),)], "full_path string"), really=True)
    assert len(gone) == 1 and len(lost) == 1 and sorted(os.listdir(tmp_path)) == ["a2.txt", "keep.txt"]


@pytest.mark.parametrize("values,w,h", [([5], 10, 4), ([1] * 7, 3, 9), ([100, 60, 20, 10, 5, 1], 100, 60), (list(range(80, 0, -1)), 200, 10)])
def test_treemap(values, w, h):
    boxes = treemap.squarify(list(map(float, values)), 0, 0, w, h)
    assert sum(a * b for _, _, a, b in boxes) == pytest.approx(w * h)
    for v, (x, y, a, b) in zip(values, boxes):
        assert a * b == pytest.approx(v / sum(values) * w * h)
        assert x >= -1e-9 and y >= -1e-9 and x + a <= w + 1e-6 and y + b <= h + 1e-6
    for (x, y, a, b), (p, q, c, d) in itertools.combinations(boxes, 2):
        assert min(x + a, p + c) - max(x, p) < 1e-6 or min(y + b, q + d) - max(y, q) < 1e-6


def test_treemap_layout(spark):
    nodes = nodes_of(spark, {f"/big/{i:03}": i for i in range(80)} | {"/x": 4})
    out = treemap.layout(treemap.candidates(nodes)).toPandas()
    assert len(out[out.parent_path == "/big"]) == 60 and (out.size_bytes > 0).all()
    assert out.assign(a=out.width * out.height).groupby("parent_path").a.sum().tolist() == pytest.approx([6000, 6000])


def test_scan_exports_and_command_line(spark, tmp_path):
    root = tmp_path / "root"
    (root / "nested" / "empty").mkdir(parents=True)
    for n in ("alpha.txt", "beta.log", "gamma.txt", "nested/delta.txt"):
        (root / n).write_bytes(bytes(1024))
    (root / 'q"u,o<te&.bin').write_bytes(b"x")
    os.symlink(root / "nested", root / "link")
    nodes = fsnodes.scan(spark, str(root), partitions=2).persist()
    got = table(nodes)
    assert got["/"] == (4097, 5, True) and got["/nested/empty"] == (0, 0, True) and "/link" not in got
    find = lambda **k: search.search(nodes, search.SearchCriteria(**k)).count()
    assert find(extensions=[".txt"], include_directories=False) == 3 and find(min_size=2048, include_directories=False) == 0
    assert {r.full_path for r in fsnodes.duplicates(nodes.where("NOT is_directory"), str(root)).collect()} == {"/alpha.txt", "/beta.log", "/gamma.txt", "/nested/delta.txt"}
    with pytest.raises(Exception, match="no such folder"):
        fsnodes.scan(spark, str(root / "none")).count()
    store = str(tmp_path / "store")
    assert cli.main(["--scan", str(root)], spark) == 1
    assert cli.main(["--scan", str(root), "--snapshot-compare", store, "--quiet"], spark) == 1
    args = ["--scan", str(root), "--export-csv", str(tmp_path / "o.csv"), "--export-html", str(tmp_path / "o.html"), "--snapshot-save", store, "--quiet"]
    assert cli.main(args, spark) == 0
    lines = (tmp_path / "o.csv").read_text().splitlines()
    assert lines[0] == ",".join(export.CSV_COLUMNS) and any('"q""u,o<te&.bin"' in x for x in lines) and len(lines) == 1 + len(got)
    page = (tmp_path / "o.html").read_text()
    assert "q&quot;u,o&lt;te&amp;.bin" in page and f"{len(got)} items" in page
    assert "Last modified (UTC)" in page and page.count("<tr class='folder'>") == sum(folder for _, _, folder in got.values())
    (root / "beta.log").rename(root / "moved.log")
    assert cli.main(["--scan", str(root), "--snapshot-compare", store], spark) == 0
    assert cli.main(["--scan", str(root / "none"), "--snapshot-save", store], spark) == 2
    assert snapshots.headers(spark, store).first().snapshot_id == "baseline"


def test_import_json(spark, tmp_path):
    node = lambda path, kind, size, n, kids=(): {"Name": path.split("\\")[-1], "FullPath": path, "NodeType": kind, "SizeInBytes": size, "FileCount": n, "LastModifiedUtc": "0001-01-01T00:00:00" if kind == 0 else "2024-05-01T10:00:00Z", "Children": list(kids)}
    doc = {"FormatVersion": 1, "RootPath": "C:\\r", "Root": node("C:\\r", 0, 5, 1, [node("C:\\r\\d", 0, 5, 1, [node("C:\\r\\d\\f.txt", 1, 5, 1)])])}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    got = snapshots.import_json(spark, str(tmp_path / "s.json"))
    assert table(got) == {"/": (5, 1, True), "/d": (5, 1, True), "/d/f.txt": (5, 1, False)}
    assert got.columns == [c.split()[0] for c in NODES.split(", ")]
    (tmp_path / "null.json").write_text("null")
    with pytest.raises(Exception, match="the snapshot is empty"):
        snapshots.import_json(spark, str(tmp_path / "null.json")).count()


def test_permissions(spark, tmp_path):
    from arborlake.functions.versions import acl_order
    from arborlake.sources import acl

    (tmp_path / "f").write_text("x")
    os.chmod(tmp_path / "f", 0o640)
    got = acl.permissions(spark.createDataFrame([(str(tmp_path / "f"),), (str(tmp_path / "none"),)], "full_path string")).collect()
    assert [r.rights for r in got] == ["Read & write", "Read", "None"] and got[2].identity == "others"
    rows = spark.createDataFrame([("b", False, False), ("a", False, False), ("c", True, False), ("d", False, True)], "identity string, deny boolean, inherited boolean")
    assert [r.identity for r in rows.orderBy(*acl_order()).collect()] == ["c", "a", "b", "d"]


def test_csv_sink(spark, tmp_path):
    nodes = nodes_of(spark, {'/ lead,"q"': 1, "/plain": 2})
    export.write_csv(nodes, str(tmp_path / "csv"), 3)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["Name"] for r in back.collect()} == {"/", ' lead,"q"', "plain"}


def test_numbering_and_progress(spark):
    got = number_rows(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k")), F.col("k")).collect()
    assert all(r.nth == r.k + 1 for r in got) and len(got) == 1000
    seen, now = [], [0.0]
    t = progress.Throttle(seen.append, 0.1, lambda: now[0])
    for step in range(5):
        now[0] = step * 0.05
        t(step)
    t(99, final=True)
    assert seen == [0, 2, 4, 99]
    df, figures = progress.observed(nodes_of(spark, {"/a": 3, "/b/c": 4}))
    with progress.cancellable(spark, "scan"):
        df.write.format("noop").mode("overwrite").save()
    assert figures.get == {"files": 2, "folders": 2, "bytes": 7}


def test_running_totals(spark, tmp_path):
    schema = "scan_id string, size_bytes bigint"
    spark.createDataFrame([("s", 3), ("s", 4), ("t", 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = progress.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("totals").collect()} == {("s", 2, 7), ("t", 1, 1)}


def test_similar_pairs_name_the_first_image_of_a_hash(spark):
    rows = [("/b", 5), ("/a", 5), ("/c", 4), ("/d", 4), ("/none", None), ("/far", -1)]
    images = spark.createDataFrame(rows, "full_path string, hash bigint")
    assert [tuple(r) for r in similar.image_pairs(images, 3).collect()] == [("/a", "/c", 1)]
    assert {(r.full_path, r.representative) for r in similar.representatives(images).collect()} == {("/a", "/a"), ("/b", "/a"), ("/c", "/c"), ("/d", "/c"), ("/far", "/far")}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ranks_within_hot_keys(spark, seed):
    """One key with most of the rows, null keys and keys of one row rank as a window ranks them."""
    rng = random.Random(seed)
    keys = ["hot"] * 3000 + [None] * 500 + [f"k{i}" for i in range(300)] * 2
    rng.shuffle(keys)
    rows = [(k, rng.choice([1, None]), i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k string, m int, v int").repartition(5)
    want, seen = {}, {}
    for k, m, v in sorted(rows, key=lambda r: -r[2]):
        want[v] = seen[k, m] = seen.get((k, m), 0) + 1
    for hot_rows in (100, 10**6):
        got = rank_within(df, ["k", "m"], [F.desc("v")], hot_rows=hot_rows)
        assert got.columns == ["k", "m", "v", "rank"] and {r.v: r["rank"] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = rank_within(df, ["k", "m"], [F.desc("v")], hot_rows=100).where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(r["count"] for r in parts) < 1500  # the hot key is no single task
    assert rank_within(df.limit(0), ["k"], [F.col("v")], hot_rows=0).count() == 0


def test_operators_with_hot_keys(spark):
    rng = random.Random(7)
    files = [(f"/d{i % 7}/f{i}", 3, datetime(2024, 1, 1 + i % 5), b"abc" if i % 10 else b"abd") for i in range(400)]
    rng.shuffle(files)
    found = duplicates.duplicate_files(spark.createDataFrame(files, "full_path string, size_bytes bigint, modified_utc timestamp, content binary"))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(duplicates.keep_plan(found, hot_rows=20)) == rows(duplicates.keep_plan(found))
    before, after = nodes_of(spark, {f"/a/{i}/same.txt": 5 for i in range(60)}), nodes_of(spark, {f"/b/{i}/same.txt": 5 for i in range(50)} | {f"/b/x{i}.txt": 5 for i in range(9)})
    diff = snapshot.changes(before, after)
    assert rows(snapshot.moves(diff, hot_rows=4)) == rows(snapshot.moves(diff)) and len(rows(snapshot.moves(diff))) >= 59
    batch = spark.createDataFrame([(f"/x/{i}.txt", i) for i in range(200)], "full_path string, ord bigint")
    options = rename.RenameOptions(find=r"\d", is_regex=True, prefix="p")
    assert rows(rename.preview(batch, options, hot_rows=5)) == rows(rename.preview(batch, options))


def test_duplicates_narrow_before_they_digest(spark):
    """Same size, same first 4 KiB, other tail; unreadable, empty and lone files."""
    head = b"h" * 4096
    rows = [("/1", head + b"1"), ("/2", head + b"2"), ("/3", head + b"1"), ("/4", head), ("/5", head), ("/6", b"x"), ("/7", b"y"), ("/8", b""), ("/9", b""), ("/n", None), ("/o", None)]
    files = spark.createDataFrame([(p, len(c or b""), None, c) for p, c in rows], "full_path string, size_bytes bigint, modified_utc timestamp, content binary")
    got = duplicates.duplicate_files(files)
    assert {(r.full_path, r.copies) for r in got.collect()} == {("/1", 2), ("/3", 2), ("/4", 2), ("/5", 2)}
    assert "sha2" not in got._jdf.queryExecution().optimizedPlan().toString()  # digests are taken once and written


def test_rename_leaves_folders_and_blank_names(spark):
    batch = spark.createDataFrame([("/a/x.txt", 1, False), ("/a/x", 2, True), ("/a/y.txt", 3, False), ("/a/\u00a0z.txt", 4, False)], "full_path string, ord bigint, is_directory boolean")
    got = {r.full_path: (r.new_name, r.error) for r in rename.preview(batch, rename.RenameOptions(find=r"[xyz]", is_regex=True, replace="\t ")).collect()}
    assert got == {"/a/x.txt": ("\t .txt", rename.EMPTY), "/a/y.txt": ("\t .txt", rename.EMPTY), "/a/\u00a0z.txt": ("\u00a0\t .txt", rename.EMPTY)}


def test_treemap_of_many_folders(spark):
    """All folders together give what each gives alone."""
    rng = np.random.Generator(np.random.PCG64(3))
    folders = [np.sort(rng.choice([1.0, 2.0, 50.0, 1e6, 7e12], n) * rng.integers(1, 9, n))[::-1] for n in [1, 2, 3, 60, 60, 59, *rng.integers(1, 61, 60)]]
    values, count = np.zeros((len(folders), 60)), np.array([len(f) for f in folders])
    for k, f in enumerate(folders):
        values[k, : len(f)] = f
    for w, h in ((100, 60), (5, 300)):
        boxes = treemap.squarify_many(values, count, w, h)
        for k, f in enumerate(folders):
            assert boxes[k, : len(f)].ravel().tolist() == pytest.approx([x for b in treemap.squarify(f.tolist(), 0.0, 0.0, float(w), float(h)) for x in b], rel=1e-9, abs=1e-7)
    assert treemap.layout(treemap.candidates(nodes_of(spark, {"/a": 1})).limit(0)).count() == 0


def test_reports_are_in_order(spark, tmp_path):
    """Part files that tasks write, joined, are the file that one writer would write."""
    nodes = nodes_of(spark, {f'/d{i % 5}/n{i},"{i % 3}" é <&>\n.txt': i * 37 % 1000 for i in range(400)}).persist()
    rows = nodes.orderBy("traversal_ord").collect()
    export.write_csv_file(nodes, str(tmp_path / "o.csv"), 1000, bom=True)
    cells = {r["Full Path"]: r for r in export.csv_rows(nodes, 1000).collect()}
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c
    want = "\ufeff" + ",".join(export.CSV_COLUMNS) + "\n" + "".join(",".join(map(quoted, cells[r.full_path])) + "\n" for r in rows)
    assert (tmp_path / "o.csv").read_bytes() == want.encode()
    export.write_html(nodes, str(tmp_path / "o.html"), "A & B", 1000)
    page = (tmp_path / "o.html").read_text()
    lines = {r.full_path: r.value for r in export.html_lines(nodes, 1000).join(nodes, ["size_bytes", "traversal_ord"]).collect()}
    order = [r.full_path for r in nodes.orderBy(F.desc("size_bytes"), "traversal_ord").collect()]
    assert page.endswith("".join(lines[p] + "\n" for p in order) + "</table></body></html>\n") and "<h1>A &amp; B</h1>" in page
    assert sorted(os.listdir(tmp_path)) == ["o.csv", "o.html"]
    export.write_csv_file(nodes.limit(0), str(tmp_path / "o.csv"))
    assert (tmp_path / "o.csv").read_text() == ",".join(export.CSV_COLUMNS) + "\n"


@pytest.mark.parametrize("seed", [1, 2])
def test_rename_chains(spark, seed):
    """Chains, circles and what leads into them, against applying the renames one by one."""
    rng = random.Random(seed)
    names = [f"/n{i}" for i in range(60)]
    pairs = [(names[i], names[i + 1]) for i in range(0, 25) if i % 9] + [(names[30], names[31]), (names[31], names[32]), (names[32], names[30]), (names[40], "/free"), (names[41], names[41].upper()), (names[42], names[43])]
    rng.shuffle(pairs)
    kept = [("/n50", "/stays", "an error"), ("/n51", "/n51", None), ("/n52", "/n50", None), ("/n53", "/n51", None), ("/n54", "/n53", None)]
    pairs += [x[:2] for x in kept[2:]]
    rows = spark.createDataFrame([(a, b[1:], b, i, None) for i, (a, b) in enumerate(pairs)] + [(a, b[1:], b, 99 + i, e) for i, (a, b, e) in enumerate(kept[:2])], "full_path string, new_name string, new_path string, ord int, error string")
    got = {r.full_path: r for r in rename.chains(rows).collect()}
    there, failed = {a.lower() for a, _ in pairs} | {"/n50", "/n51"}, set()
    for a, b in pairs:
        if b.lower() != a.lower() and b.lower() in there:
            failed.add(a)
        else:
            there.discard(a.lower())
            there.add(b.lower())
    assert {a for a, r in got.items() if r.fails_in_order} == failed
    moves = dict(pairs)
    for a, r in got.items():
        n, at = 0, moves[a]
        while at in moves and n < 99:
            n, at = n + 1, moves[at]
        assert (r.waits, r.in_cycle) == ((None, True) if n == 99 else (n, False))
    assert len(got) == len(pairs) - 1  # a new case only waits for nothing
    assert rename.chains(rows.limit(0)).count() == 0


def test_stored_snapshots_are_compared_without_a_shuffle(spark):
    before, after = nodes_of(spark, {"/a/x": 5, "/A/y": 2, "/gone": 1}), nodes_of(spark, {"/a/X": 5, "/a/y": 3, "/new/z": 1})
    stored = []
    for name, nodes in (("stored_before", before), ("stored_after", after)):
        snapshots.save_table(nodes, name, 5)
        stored.append(snapshots.load_table(spark, name))
    try:
        got = snapshot.changes(*stored)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, snapshot.changes(before, after).collect())) and got.count() == 5
    finally:
        for name in ("stored_before", "stored_after"):
            snapshots.drop_table(spark, name)


def _whole_tree(doc):
    """Paths of a document in the order that they stand in, with size, number of files and kind."""
    out, stack = [], [doc["Root"]]
    while stack:
        n = stack.pop()
        out.append((n["FullPath"], n["SizeInBytes"], n["FileCount"], n["IsDirectory"], n["LastModifiedUtc"], n["Extension"], n["Name"]))
        stack += reversed(n["Children"])
    return out


ODD_FILES = ["/a/{\"Name\":\"x\"}.txt", "/a/{", "/a/b\\\"{.log", "/a/,\"Children\":[", "/a/é\t\x1f]}", "/a", "/a!/f", "/a\x03/f", "/a/\U0010fffd", "/z/y/x/w.tar.gz"]


def _odd_nodes(spark):
    when = datetime(2024, 5, 1, 10, 0, 0, 123456)
    rows = [(p, i, when if i % 2 else None) for i, p in enumerate(ODD_FILES) if p != "/a"]
    return rollup.build_nodes(spark.createDataFrame(rows, "full_path string, size_bytes long, modified_utc timestamp"), spark.createDataFrame([("/empty/e",)], "full_path string"))


@pytest.mark.parametrize("root_path", ["/", "/data/{\"x"])
@pytest.mark.parametrize("split", ["64", "134217728"])
def test_nested_json_round_trip(spark, tmp_path, root_path, split):
    """The document is what a parser of whole documents reads, and comes back as it was, however it is cut into splits."""
    nodes = _odd_nodes(spark)
    path = str(tmp_path / "s.json")
    snapshots.write_json(nodes, path, datetime(2024, 6, 1, tzinfo=timezone.utc), root_path)
    doc = json.loads((tmp_path / "s.json").read_text())
    assert doc["FormatVersion"] == 1 and doc["TakenUtc"] == "2024-06-01T00:00:00.000000Z" and doc["RootPath"] == root_path == doc["Root"]["FullPath"]
    base = root_path.rstrip("/")
    want = [
        (base + r.full_path if r.depth else root_path, r.size_bytes, r.file_count, r.is_directory, f"{r.modified_utc:%Y-%m-%dT%H:%M:%S.%fZ}" if r.modified_utc else "0001-01-01T00:00:00", r.extension)
        for r in sorted(nodes.collect(), key=lambda r: r.traversal_ord)
    ]
    assert [r[:6] for r in _whole_tree(doc)] == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = snapshots.import_json(spark, path)
        if split == "64":
            assert got.rdd.getNumPartitions() > 1
        assert "MapInPandas" not in got._jdf.queryExecution().toString()
        assert sorted(map(tuple, got.drop("scan_id").collect()), key=str) == sorted(map(tuple, nodes.drop("scan_id").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_nested_json_of_other_writers(spark, tmp_path):
    """Backslashes, one document a file, other layouts, and documents that break off."""
    leaf = lambda p, size: {"Name": p.split("\\")[-1], "FullPath": p, "IsDirectory": False, "SizeInBytes": size, "FileCount": 1, "LastModifiedUtc": "2024-05-01T10:00:00.1234567Z", "Extension": ".txt", "Children": []}
    folder = lambda p, kids: leaf(p, sum(k["SizeInBytes"] for k in kids)) | {"IsDirectory": True, "FileCount": len(kids), "Extension": None, "Children": kids}
    doc = lambda root: {"FormatVersion": 1, "TakenUtc": "2024-05-01T10:00:00Z", "RootPath": root["FullPath"], "Root": root}
    first = doc(folder("C:\\", [leaf("C:\\f{}.txt", 3), folder("C:\\d", [leaf("C:\\d\\g.txt", 4)])]))
    second = doc(folder("D:\\t", [leaf("D:\\t\\h.txt", 5)]))
    want = {"/": (7, 2, True), "/f{}.txt": (3, 1, False), "/d": (4, 1, True), "/d/g.txt": (4, 1, False)}
    for layout, whole in (({"separators": (",", ":")}, False), ({"indent": 2}, True), ({"separators": (",", ":"), "sort_keys": True}, True), ({}, True)):
        many = tmp_path / f"many-{len(layout)}-{whole}-{'indent' in layout}"
        many.mkdir()
        (many / "one.json").write_text(json.dumps(first, **layout))
        got = snapshots.import_json(spark, str(many / "one.json"))
        assert ("MapInPandas" in got._jdf.queryExecution().toString()) == whole
        assert table(got) == want
        assert {r.modified_utc for r in got.collect()} == {datetime(2024, 5, 1, 10, 0, 0, 123456)}
        (many / "two.json").write_text(json.dumps(second, **layout))
        both = snapshots.import_json(spark, str(many))
        assert sorted(r.full_path for r in both.collect()) == sorted([*want, "/", "/h.txt"])
    text = json.dumps(first, separators=(",", ":"))
    for i, broken in enumerate((text[:-3], text[: text.index('{"Name":"d"')], "{}", '{"FormatVersion":1}')):
        (tmp_path / f"broken-{i}.json").write_text(broken)
        with pytest.raises(Exception, match="JSONDecodeError|the snapshot is empty"):
            snapshots.import_json(spark, str(tmp_path / f"broken-{i}.json")).count()


def test_command_line_compares_with_a_json_document(spark, tmp_path, capsys):
    root = tmp_path / "root"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a.txt").write_text("abc")
    (root / "gone.txt").write_text("12345")
    file = str(tmp_path / "before.json")
    assert cli.main(["--scan", str(root), "--snapshot-json", file, "--quiet"], spark) == 0
    assert json.loads(Path(file).read_text())["RootPath"] == str(root)
    (root / "gone.txt").unlink()
    (root / "d" / "a.txt").write_text("abcd")
    assert cli.main(["--scan", str(root), "--snapshot-compare", file], spark) == 0
    said = capsys.readouterr().out
    assert "Added 0, removed 1, changed 2, moved 0; net change -4 B" in said and "removed: /gone.txt" in said
