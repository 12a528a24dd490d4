"""Scans of folders on disk: odd entries, skewed trees, both ways of reading."""

import os
import statistics

import numpy as np
import pytest
from conftest import DATA

from arborlake.functions import dhash
from arborlake.sources import adapters, fsnodes, images


def shown(rows, root):
    return {r.full_path[len(str(root)) :] or "/": (r.size_bytes, r.is_directory) for r in rows.collect()}


def plain_walk(root):
    """What a recursive walk finds: path to whether it is a folder."""
    found = {"/": True}
    for folder, folders, files in os.walk(root):
        at = folder[len(str(root)) :]
        found |= {f"{at}/{f}": True for f in folders if not os.path.islink(f"{folder}/{f}")} | {f"{at}/{f}": False for f in files}
    return found


@pytest.fixture
def odd_tree(tmp_path):
    for p in ("a/b/c/d/e", "x", "empty", "y/z"):
        (tmp_path / p).mkdir(parents=True)
    for p in ("a/1", "a/b/c/d/e/2", "x/3", "y/z/4", ".hidden", "x/line\nbreak"):
        (tmp_path / p).write_bytes(b"abc")
    for p in ("loop", "y/loop", "a/b/loop"):
        os.symlink("loop", tmp_path / p)  # a link to itself
    os.symlink("nowhere", tmp_path / "x/broken")
    os.symlink(tmp_path / "a", tmp_path / "x/up")
    with open(os.fsencode(tmp_path) + b"/x/\xff\xfe", "wb"):
        pass
    os.mkdir(os.fsencode(tmp_path) + b"/\xe4")
    with open(os.fsencode(tmp_path) + b"/\xe4/inside", "wb") as f:
        f.write(b"1234")
    return tmp_path


@pytest.mark.parametrize("partitions, budget", [(64, 100_000), (2, 1), (3, 4)])
def test_no_sub_tree_is_lost(spark, odd_tree, partitions, budget):
    rows = fsnodes.walk(spark, str(odd_tree), partitions=partitions, budget=budget)
    got = shown(rows, odd_tree)
    assert len(got) == rows.count() == 23
    assert got["/loop"] == got["/y/loop"] == got["/a/b/loop"] == (0, False) and got["/x/broken"] == (0, False)
    assert "/x/up" not in got and got["/a/b/c/d/e/2"] == got["/x/line\nbreak"] == (3, False) and got["/empty"] == (0, True)
    assert got["/�/inside"] == (4, False) and got["/x/��"] == (0, False)
    assert not rows.where("access_denied").count()
    nodes = {r.full_path: (r.size_bytes, r.file_count) for r in fsnodes.scan(spark, str(odd_tree), partitions=partitions, budget=budget).collect()}
    assert nodes["/"] == (22, 12) and nodes["/a"] == (6, 3) and len(nodes) == 23


def test_data_source(spark, odd_tree):
    fsnodes.register(spark)
    for n in (1, 4, 64):
        rows = spark.read.format("fsnodes").options(path=str(odd_tree), partitions=n).load()
        assert shown(rows, odd_tree) == shown(fsnodes.walk(spark, str(odd_tree)), odd_tree)
    for bad, why in ((" ", "a root path is needed"), (str(odd_tree / "none"), "no such folder")):
        with pytest.raises(Exception, match=why):
            spark.read.format("fsnodes").options(path=bad).load().count()
        with pytest.raises((ValueError, FileNotFoundError), match=why):
            fsnodes.walk(spark, bad)


def test_followed_links_count_once(spark, tmp_path):
    for p in ("real/deep", "other"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "real/deep/f").write_bytes(b"12345")
    os.symlink(tmp_path / "real", tmp_path / "real/deep/back")  # leads up again
    os.symlink(tmp_path / "real/deep", tmp_path / "other/there")
    os.symlink(tmp_path, tmp_path / "real/top")
    got = shown(fsnodes.walk(spark, str(tmp_path), follow_links=True), tmp_path)
    assert got == {"/": (0, True), "/real": (0, True), "/other": (0, True), "/other/there": (0, True), "/other/there/f": (5, False)}


def test_a_skewed_tree_is_dealt_anew(spark, tmp_path):
    """Half of all folders hang below one chain; still no task of a round makes more than twice the rows of the median one."""
    base = str(tmp_path / "tree")
    files = adapters.deep_files(spark, f"{DATA}/sf0.01")
    hot = files.selectExpr("concat('/hot/a/b/c/d/e/f', full_path) AS full_path", "size_bytes", "modified_utc")
    fsnodes.create_files(files.select(*hot.columns).union(hot), base)
    rows = fsnodes.walk(spark, base, partitions=4, budget=100).cache()
    assert {r.full_path[len(base) :] or "/": r.is_directory for r in rows.collect()} == plain_walk(base)
    tasks = rows.groupBy("round", "task").count().groupBy("round").agg({"count": "collect_list"}).sort("round").collect()
    full = [r[1] for r in tasks if len(r[1]) == 4][:-1]  # the last round takes what is left
    assert len(full) > 3 and all(max(n) <= 2 * statistics.median(n) for n in full)


def test_listing_that_breaks_off(monkeypatch, tmp_path):
    (tmp_path / "f").write_bytes(b"1")

    class Broken:
        def __init__(self, path):
            self.entries = os_scandir(path)

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.entries.close()

        def __next__(self):
            entry = next(self.entries, None)
            if entry is None:
                raise OSError("the disk is gone")
            return entry

    os_scandir = os.scandir
    monkeypatch.setattr(os, "scandir", Broken)
    files, folders, complete = fsnodes.list_folder(os.fsencode(tmp_path), False)
    assert [f[0] for f in files] == [os.fsencode(tmp_path / "f")] and not folders and not complete
    assert fsnodes.folder_row(os.fsencode(tmp_path), complete)[4]


def test_images_are_decoded_without_a_python_library(spark, tmp_path):
    """PNG, BMP and GIF keep their pixels, so their hashes are those of the pixels; JPEG has that of what the JVM decodes."""
    rng = np.random.Generator(np.random.PCG64(8))
    jvm, want = spark._jvm, {}
    (tmp_path / "deep").mkdir()
    for k, (w, h) in enumerate([(9, 8), (40, 30), (7, 90)]):
        shades = rng.integers(0, 200, (h, w))
        for kind in ("png", "bmp", "gif", "jpg"):
            picture = jvm.java.awt.image.BufferedImage(w, h, 1)
            for y in range(h):
                for x in range(w):
                    picture.setRGB(x, y, int(shades[y, x] // 8 * 8) * 0x10101)
            name = f"deep/{k}.{kind.upper() if k == 1 else kind}"
            assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(str(tmp_path / name)))
            read = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / name)))
            rgb = np.array([[read.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
            grey = 0.114 * (rgb & 255) + 0.587 * (rgb >> 8 & 255) + 0.299 * (rgb >> 16)
            want[name] = dhash.grid_hash(dhash.shrink(grey))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "other.txt").write_bytes(b"no image")
    got = {r.origin.split(str(tmp_path) + "/")[1]: r.hash for r in images.image_hashes(spark, str(tmp_path)).collect()}
    assert got == want | {"broken.png": None}
