"""The Merkle manifest and the filter audit against plain Python on small tables."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest
from arborlake.llm import op11_merkle_manifest, op13_filter_audit
from arborlake.llm.common import Scratch

from .conftest import ODD, prose


# the manifest


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def framed(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """The levels of a tree, the last one of one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    for now in levels[:-1]:
        b = i // 8 * 8
        yield now[b:i], now[i + 1 : b + 8]
        i //= 8


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text)."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    trees = {}
    for p in order:
        parts[p].sort(key=lambda r: (r[0] is not None, r[0] or 0, framed(r)))
        trees[p] = tree([framed(r) for r in parts[p]])
    top = tree([trees[p][-1][0] for p in order])
    root, out = top[-1][0], []
    for k, p in enumerate(order):
        for i, r in enumerate(parts[p]):
            path = [*siblings(trees[p], i), *siblings(top, k)]
            node = framed(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = framed((*r[:4], lower(r[4])))
            for a, b in path:
                node = h("".join(a) + node + "".join(b))
            out.append((r[0], framed(r), trees[p][-1][0], root, h("".join("".join(a + b) for a, b in path)), node, node == root))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string, part string, idx bigint, node string")


def some_rows(seed, n):
    rng, rows = random.Random(seed), []
    for i in rng.sample([*range(-50, 4000, 3), *range(10**12, 10**12 + 900, 7), -(2**62), 2**62], n):
        text = rng.choice(["Abc DEF", "abc", "É Ö", None, "", "x"]) if i % 2 else f"Text {i}"
        rows.append((i, rng.choice(["web", None]), rng.choice(["en", "de", None, "", "zh", "e", "enx"]), rng.choice([3, None]), text))
    return rows


@pytest.mark.parametrize("depth, most_rows, n", [(4, 1 << 16, 300), (1, 1 << 16, 700), (2, 4, 300)])
def test_manifest(spark, depth, most_rows, n):
    """Several rounds of small tiles, and leaves that rank by their digests, give what one tree gives."""
    rows = some_rows(n, n)
    rows += rows[:5] + [(None, None, "en", None, t) for t in ("a", "b", None)] + [(7, "s", "en", 1, t) for t in "abcab"]
    got = op11_merkle_manifest.manifest(documents(spark, [(*r, "clash", 1, "clash") for r in rows]), depth=depth, most_rows=most_rows)
    assert sorted(map(tuple, got.collect()), key=str) == manifest(rows)


def test_manifest_of_little(spark):
    assert op11_merkle_manifest.manifest(documents(spark, [])).count() == 0
    rows = [(5, "s", None, 1, "LONE")]
    got = op11_merkle_manifest.manifest(documents(spark, [(*r, "", 1, "") for r in rows]))
    assert list(map(tuple, got.collect())) == manifest(rows)
    odd = [(i, "s", "en", len(t or ""), t) for i, t in enumerate(ODD)]
    got = op11_merkle_manifest.manifest(documents(spark, [(*r, "", 1, "") for r in odd]))
    assert sorted(map(tuple, got.collect()), key=str) == manifest(odd)


def test_rows_before_is_the_rank(spark):
    rng = random.Random(4)
    cells = {(rng.choice("ab"), rng.choice([rng.randrange(-9, 9), rng.randrange(2**40), rng.randrange(-(2**63), 2**63)])): rng.randrange(1, 5) for _ in range(400)}
    df = spark.createDataFrame([(g, v, n) for (g, v), n in cells.items()], "g string, v bigint, n bigint")
    before, sizes = op11_merkle_manifest.rows_before(df, ["g"], "v", Scratch(spark))
    want = {(g, v): sum(n for (g2, w), n in cells.items() if g2 == g and w < v) for g, v in cells}
    assert {(r.g, r.v): r.before for r in before.collect()} == want
    assert {r.g: r.n for r in sizes.collect()} == {g: sum(n for (g2, _), n in cells.items() if g2 == g) for g in "ab"}


# the audit


def audit(docs, labels):
    """(part, order, step, kept, removed, redundant, unique, good, toxic, shapley) of (doc_id, lang, text) and (doc_id, quality, toxic)."""
    first = {}
    for i, _, t in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, lang, t in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in t for c in "#$%&*|"), "E": i is not None and i > first[t]}
        mark = lambda k: any(x[k] == 1 for x in labels if i is not None and x[0] == i)
        rows.append((lang or "", {f for f in fails if fails[f]}, mark(1), mark(2)))
    out = []
    for part in {r[0] for r in rows}:
        mine, steps = [r for r in rows if r[0] == part], []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [r for r in mine if f in r[1] and not r[1] & set(order[:k])]
                kept = sum(not r[1] & set(order[: k + 1]) for r in mine)
                steps.append([part, "".join(order), k + 1, kept, len(here), sum(f in r[1] for r in mine) - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)])
        total = {f: sum(s[4] for s in steps if s[1][s[2] - 1] == f) for f in "ABCDE"}
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit(spark):
    rng = random.Random(13)
    texts = [*ODD, None, "same" * 3, "same" * 3, "same" * 3, *(prose(rng, rng.choice([20, 250]), rng.choice([30, 3000])) + rng.choice(["", " #", " AAAAAAAAAAAAAAAAAAAA" * 9]) for _ in range(60))]
    docs = [(i, rng.choice(["en", "de", None, ""]), t) for i, t in enumerate(texts)]
    docs += [docs[1], docs[-1], (None, "en", "same" * 3), (3, "en", "same" * 3), (-4, "fr", docs[-1][2])]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-4, 60)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash", 1, "clash") for d in docs], "doc_id bigint, lang string, text string, part string, n bigint, digest string")
    got = op13_filter_audit.audit(frame, spark.createDataFrame([(*x, 0) for x in labels], "doc_id bigint, quality int, toxic int, good int"))
    assert sorted(map(tuple, got.collect())) == audit(docs, labels)
    none = op13_filter_audit.audit(frame.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert none.count() == 0 and none.columns == got.columns
