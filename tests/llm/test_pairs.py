"""Near duplicates, repeated passages and the pipeline against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from conftest import DATA

from arborlake.llm import chunks, op3_minhash_dedup, op10_substring_dedup, op12_ngram_join

from .conftest import ODD, edited, prose


def shingle_set(text, width=4):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute_components(texts):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in texts]
    for i, _ in sets:
        root.setdefault(i, i)
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed):
    rng = random.Random(seed)
    texts = [*ODD]
    line = prose(rng, 12)
    for _ in range(6):
        base = prose(rng, rng.randrange(30, 200))
        texts += [base, base.upper(), *(edited(rng, base, rng.randrange(0, 8)) for _ in range(12))]
    texts += [f"{line} {prose(rng, rng.randrange(0, 12))}" for _ in range(60)]  # short texts around one common line
    texts += [prose(rng, 50) for _ in range(20)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(table, seed):
    texts = corpus(seed)
    got = {r.doc_id: r for r in op3_minhash_dedup.near_duplicates(table(texts)).collect()}
    want = brute_components(list(enumerate(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    for i, t in enumerate(texts):
        assert got[i].n_shingles == len(shingle_set(t)) and got[i].kept == (want[i] == i)


def test_near_duplicates_on_odd_rows(table):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(9, base), (9, base), (7, base + " end"), (None, base), (5, None), (5, ""), (3, "a b"), (2, "A  B"), (4, "b a")]
    got = sorted(map(tuple, op3_minhash_dedup.near_duplicates(table(rows)).collect()), key=str)
    assert got == sorted([(9, 37, 7, False), (9, 37, 7, False), (7, 38, 7, True), (None, 37, None, True), (5, 0, 5, True), (5, 0, 5, True), (3, 1, 2, False), (2, 1, 2, True), (4, 1, 4, True)], key=str)
    assert op3_minhash_dedup.near_duplicates(table(ODD).limit(0)).count() == 0


def test_rounds_over_a_hot_group(table, monkeypatch):
    """Many rounds with few pairs each give what one round gives."""
    monkeypatch.setattr(op3_minhash_dedup, "ROUND_PAIRS", 40)
    texts = corpus(3)
    got = {r.doc_id: r.component_id for r in op3_minhash_dedup.near_duplicates(table(texts)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_near_duplicates_nest_no_cached_plans(table, monkeypatch):
    """A cached frame stands in a plan with all its own plan, once for each use; nested ones fill the driver's memory."""
    nested, keep = [], op3_minhash_dedup.Scratch.keep

    def noted(self, df, name):
        nested.append((df._jdf.queryExecution().executedPlan().toString().count("InMemoryRelation"), name))
        return keep(self, df, name)

    monkeypatch.setattr(op3_minhash_dedup.Scratch, "keep", noted)
    op3_minhash_dedup.near_duplicates(table(corpus(1)))
    assert "rarest" in {name for _, name in nested}  # the exact join was needed
    assert max(nested)[0] <= 4, nested  # of the components' first round


def test_banding_finds_most_pairs_at_the_threshold():
    """Of pairs of similarity 0.8, all but a few in a thousand share a key of both collections."""
    rng = np.random.default_rng(1)
    lost, n = 0, 2000
    for _ in range(n):
        common = rng.integers(0, 2**63, 80, dtype=np.uint64)
        keys = []
        for own in (rng.integers(0, 2**63, 10, dtype=np.uint64), rng.integers(0, 2**63, 10, dtype=np.uint64)):
            s = chunks.mix(np.concatenate([common, own]))
            low = np.array([((s ^ x) * m).min() for x, m in zip(op3_minhash_dedup._XOR, op3_minhash_dedup._MUL)])
            k = low.reshape(-1, op3_minhash_dedup.K)
            keys.append([tuple(r) for r in k])
        same = [a == b for a, b in zip(*keys)]
        lost += not (any(same[: op3_minhash_dedup.M]) and any(same[op3_minhash_dedup.M :]))
    assert lost / n < 0.005


def test_words_and_shingles():
    rng = random.Random(4)
    texts = [None, b"", b" \n", b"One two", b"a b c d e f", "ü ß\x0b中 x".encode(), b"w " * 3000, *(prose(rng, rng.randrange(20)).encode() for _ in range(50))]
    for most in (64, 1 << 20):
        words, at = chunks.word_hashes(texts, most=most)
        flat = [w for t in texts for w in (t or b"").lower().split()]
        assert np.diff(at).tolist() == [len((t or b"").lower().split()) for t in texts]
        assert len(set(flat)) == len(set(words.tolist())) == len(set(zip(flat, words.tolist())))
    for width, short in ((4, True), (5, False)):
        sh, sh_at = chunks.shingles(words, at, width, short)
        want = []
        for t in texts:
            w = (t or b"").lower().split()
            own = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)] or ([tuple(w)] if w and short else [])
            want.append(own)
        assert np.diff(sh_at).tolist() == list(map(len, want))
        flat = [x for own in want for x in own]
        assert len(set(flat)) == len(set(sh.tolist())) == len(set(zip(flat, sh.tolist())))


def cartesian_nodes(h, least):
    out, stack = set(), [(0, len(h))] if len(h) >= least else []
    while stack:
        a, b = stack.pop()
        c = a + int(h[a:b].argmin())
        out.add(c)
        stack += [(x, y) for x, y in ((a, c), (c + 1, b)) if y - x >= least]
    return out


def test_windows_are_those_of_the_trees():
    """Places are the nodes of the Cartesian trees, ranges the starts of the passages that are least there."""
    rng = np.random.default_rng(2)
    sizes = [0, 3, 46, 47, 200, 500, 45, 1000]
    h = rng.integers(1, 2**63, sum(sizes), dtype=np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    want = {int(at[d]) + c for d in range(len(sizes)) for c in cartesian_nodes(h[at[d] : at[d + 1]], 46)}
    c, first, last = op10_substring_dedup.compact_windows(h, at, 46)
    assert set(c.tolist()) == want and len(c) == len(want)
    got = {i: int(x) for x, a, b in zip(c, first, last) for i in range(a, b + 1)}
    assert got == {i: i + int(h[i : i + 46].argmin()) for d in range(len(sizes)) for i in range(at[d], at[d + 1] - 45)}


def test_overlaps_are_the_minima_of_passages():
    """Every passage of 50 words has the overlap of its two minima, for every two functions, and there are no others."""
    o = op10_substring_dedup
    rng = random.Random(3)
    texts = [prose(rng, n, 40).encode() for n in (20, 50, 51, 400, 0, 900)] + [b"tick " * 120]
    words, at = chunks.word_hashes(texts)
    sh, sh_at = chunks.shingles(words, at, o.SHINGLE, short=False)
    text, keys, spots = o.text_windows(sh, sh_at)
    got = list(zip(*(x.tolist() for x in o.overlaps(text, keys, spots))))
    want = set()
    for d in range(len(texts)):
        own = sh[sh_at[d] : sh_at[d + 1]]
        low = [[i + int((((own[i : i + 46] ^ o._XOR[k]) * o._MUL[k]) >> np.uint64(32)).argmin()) for i in range(len(own) - 45)] for k in range(o.HASHES)]
        for f, g in itertools.combinations(range(o.HASHES), 2):
            for x, y in set(zip(low[f], low[g])):
                key = chunks.mix(chunks.mix(own[x : x + 1] + o._XOR[f]) * np.uint64(3) + chunks.mix(chunks.mix(own[y : y + 1] + o._XOR[g]) + np.uint64(f * o.HASHES + g)))
                i = [i for i in range(len(low[f])) if (low[f][i], low[g][i]) == (x, y)]
                state = o.pack(0, o.SHINGLE, x - i[0], i[-1] + o.PASSAGE - x) if (f, g) == (0, 1) else 0
                want.add((d, int(key[0]), x, state))
    assert set(got) == want


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_near_passages(table, similarity):
    """Of planted passages edited as far as the similarity of the shingle sets allows, nine in ten are reported. Both ends are equal, as a passage's are."""
    rng, texts, near = random.Random(int(similarity * 100)), [], []
    while len(near) < 150:
        n = rng.choice((50, 60, 80, 120, 200))
        p = prose(rng, n, 10**6)
        w, best = p.split(), None
        while True:
            w[rng.randrange(5, n - 5)] = f"edit{rng.randrange(10**6)}"
            if jaccard(shingle_set(p, 5), shingle_set(" ".join(w), 5)) < similarity:
                break
            best = " ".join(w)
        if best:
            d = len(texts) + 1
            texts += [f"{prose(rng, 30, 10**6)} {p} {prose(rng, 30, 10**6)}", f"{prose(rng, 40, 10**6)} {best} {prose(rng, 20, 10**6)}"]
            near.append((d, set(range(40, 40 + n))))
    got = repeats(table(texts))
    found = sum(len(got.get(d, set()) & s) > len(s) * 0.6 for d, s in near)
    assert found >= 0.9 * len(near)
    assert set(got) <= {d for d, _ in near}


def repeats(docs, lengths=False):
    sizes, found = op10_substring_dedup.repeated_passages(docs)
    flagged = {}
    for r in found.collect():
        flagged.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    return ({r.doc_id: r.n_words for r in sizes.collect()}, flagged) if lengths else flagged


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_passages(table, seed):
    """Exact passages of 50 words and more are found word for word; shorter ones and common lines are not."""
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (50, 60, 120, 200)]
    brief = [prose(rng, n) for n in (12, 20, 35, 49)]
    texts, want, seen = [], {}, set()
    for d in range(70):
        parts, at = [], 0
        for _ in range(rng.randrange(1, 4)):
            own = prose(rng, rng.randrange(60, 100), 10**6)  # too long a gap to be bridged
            p = rng.choice(passages + brief * 2)
            parts += [own, p]
            at += len(own.split())
            if p in passages:
                if (p, "seen") in seen:
                    want.setdefault(d, set()).update(range(at, at + len(p.split())))
                seen.add((p, d))
            at += len(p.split())
        for p, x in list(seen):
            if x == d:
                seen.add((p, "seen"))
        texts.append(" ".join(parts))
    assert repeats(table(texts)) == want


def test_near_passages(table):
    """Passages with a few edited words are found, for the most part of their words."""
    rng = random.Random(3)
    texts, spans = [], {}
    for k in range(12):
        p = prose(rng, 150)
        w = edited(rng, p, 2).split()
        del w[70]
        copy = " ".join(w)
        texts += [f"{prose(rng, 40)} {p} {prose(rng, 30)}", f"{prose(rng, 25)} {copy} {prose(rng, 60)}"]
        spans[2 * k + 1] = set(range(25, 25 + 149))
    got = repeats(table(texts))
    assert set(got) <= set(spans)
    found = sum(len(got.get(d, set()) & s) for d, s in spans.items()) / sum(map(len, spans.values()))
    assert found > 0.9
    assert all(len(got[d] - s) <= 10 for d, s in spans.items() if d in got)


def equal_words(texts, size=50):
    """Words of each document in a window of `size` words that an earlier document holds."""
    first, out = {}, {}
    for d, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        windows = [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]
        for i, x in enumerate(windows):
            if first.setdefault(x, d) < d:
                out.setdefault(d, set()).update(range(i, i + size))
    return out


def test_equal_passages_off_the_leader(table):
    """Copies of a later occurrence of a line in the first holder, nested passages and periodic text are found word for word."""
    rng = random.Random(11)
    texts, far = [], 10**6
    for _ in range(40):
        line, ends = prose(rng, 40), [prose(rng, 30) for _ in range(3)]
        texts.append(" ".join(f"{line} {e} {prose(rng, 5, far)}" for e in ends))  # the line three times
        texts.append(f"{prose(rng, 60, far)} {line} {ends[2][:60]} {prose(rng, 60, far)}")
    for _ in range(40):
        head, line, tail = prose(rng, 40), prose(rng, 30), prose(rng, 30)
        texts += [f"{prose(rng, 70, far)} {head} {line} {prose(rng, 70, far)}", f"{prose(rng, 70, far)} {head} {line} {tail} {prose(rng, 70, far)}", f"{prose(rng, 70, far)} {line} {tail} {prose(rng, 70, far)}"]
    texts += ["tick " * 70 + prose(rng, 60), prose(rng, 60) + " tick" * 300, "a b c " * 40 + prose(rng, 60), "b c a " * 100]
    got, want = repeats(table(texts)), equal_words(texts)
    assert want and all(s <= got.get(d, set()) for d, s in want.items())


def test_repeated_passages_on_odd_rows(table):
    p = " ".join(f"q{i}" for i in range(80))
    rows = [*((100 + i, t) for i, t in enumerate(ODD)), (None, p), (1, p), (1, p), (2, "head " + p.upper() + " tail"), (3, "same " * 200), (4, "same " * 120)]
    sizes, got = repeats(table(rows), True)
    assert got[2] == set(range(1, 81)) and got[4] == set(range(120)) and 1 not in got and sizes[100] == 0
    assert repeats(table(ODD).limit(0)) == {}
    docs = table([(1, p), (2, f"a\n{p}\n b  c"), (3, p), (4, None), (5, "")])
    _, found = op10_substring_dedup.repeated_passages(docs)
    left = {r.doc_id: r.text for r in op10_substring_dedup.cut(docs, found).collect()}
    assert left == {1: p, 2: "a\nb  c", 4: None, 5: ""}


def test_texts_that_share_an_id(table):
    """Each text of an id has its own passages; they are no passages of one another."""
    rng = random.Random(8)
    p, q, far = prose(rng, 80, 10**6), prose(rng, 60, 10**6), prose(rng, 200, 10**6)
    rows = [(1, f"{p} x"), (2, f"a b {p} c"), (2, "short"), (2, f"{far} {q}"), (2, f"{q} y"), (3, f"z {q}"), (3, None), (4, f"z {q}"), (4, f"z {q}")]
    docs = table(rows).withColumnsRenamed({"score": "passages_id", "label": "Passages"})
    _, found = op10_substring_dedup.repeated_passages(docs)
    left = op10_substring_dedup.cut(docs, found)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted([(1, f"{p} x"), (2, "a b c"), (2, "short"), (2, f"{far} {q}"), (2, f"{q} y"), (3, "z "), (3, "")])


def test_without():
    assert op10_substring_dedup.without(b" a b  c d ", [(1, 2)]) == b" a c d "
    assert op10_substring_dedup.without(b"a b c", [(0, 2), (1, 3)]) == b""
    assert op10_substring_dedup.without("é ü ß".encode(), [(2, 3)]) == "é ü ".encode()


def test_pipeline(spark, tmp_path):
    """Each stage's decisions, on planted documents."""
    import corpus_pipeline as cp

    rng = random.Random(6)
    base = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    text = prose(rng, 120)
    passage = prose(rng, 70)
    item = max((r.text for r in bench.collect()), key=len)
    rows = [(10_000, text), (10_001, edited(rng, text, 1)), (10_002, "123 456 !!"), (10_003, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"), (10_004, f"{prose(rng, 40)}\n{passage}\n{prose(rng, 20)}"), (10_005, f"{prose(rng, 20)} {item}"), (10_006, None)]
    more = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], base.schema)
    docs = base.union(more)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at, out = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in cp.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        out[name] = {r.doc_id: r for r in at.collect()}
        if name != cp.STAGES[-1][0]:
            assert at.columns == docs.columns
    gone = set()
    for name, ids in (("language_id", {10_002, 10_006}), ("near_dedup", {10_001}), ("substring_dedup", set()), ("decontamination", {10_005}), ("byte_bpe", set())):
        gone |= ids
        assert not gone & set(out[name])
        assert {i for i, _ in rows} - gone <= set(out[name])
    assert passage in out["substring_dedup"][10_003].text and passage not in out["substring_dedup"][10_004].text
    assert out["substring_dedup"][10_004].n_chars == len(out["substring_dedup"][10_004].text)
    whole = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert whole == out["byte_bpe"]


# the n-gram join


def chains(seed):
    """Groups whose members are linked in chains, short texts around a common line, copies, odd texts."""
    rng = random.Random(seed)
    texts = [*ODD, *ODD[-2:]]
    line = prose(rng, 12)
    for _ in range(5):
        base = prose(rng, rng.randrange(60, 220))
        texts += [base, base.upper(), base]
        for _ in range(14):  # each an edit of one before
            texts.append(edited(rng, rng.choice(texts[-8:]), rng.randrange(0, 3)))
    texts += [f"{line} {prose(rng, rng.randrange(0, 5))}" for _ in range(50)]
    texts += [f"{prose(rng, rng.randrange(0, 4))} {line} {prose(rng, rng.randrange(0, 3))}" for _ in range(30)]
    rng.shuffle(texts)
    return texts


def brute_links(texts, similarity):
    sets, near = [(i, shingle_set(t)) for i, t in texts], {}
    for i, _ in sets:
        near.setdefault(i, i)

    def top(x):
        while near[x] != x:
            x = near[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= similarity * len(a | b):
            x, y = top(i), top(j)
            near[max(x, y)] = min(x, y)
    return {i: top(i) for i in near}


@pytest.mark.parametrize("seed, similarity", [(1, 85), (2, 85), (3, 70), (4, 95)])
def test_ngram_join(table, seed, similarity):
    texts = chains(seed)
    got = {r.doc_id: r for r in op12_ngram_join.ngram_join(table(texts), similarity=similarity).collect()}
    assert {i: r.component_id for i, r in got.items()} == brute_links(list(enumerate(texts)), similarity)
    assert all(got[i].n_shingles == len(shingle_set(t)) for i, t in enumerate(texts))


def test_ngram_join_on_odd_rows(table):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(9, base), (9, base), (7, base + " end"), (None, base), (5, None), (5, ""), (3, "a b"), (2, "A  B"), (4, "b a"), (4, base + " END")]
    got = sorted(map(tuple, op12_ngram_join.ngram_join(table(rows)).collect()), key=str)
    assert got == sorted([(9, 37, 4), (9, 37, 4), (7, 38, 4), (None, 37, None), (5, 0, 5), (5, 0, 5), (3, 1, 2), (2, 1, 2), (4, 1, 4), (4, 38, 4)], key=str)
    assert op12_ngram_join.ngram_join(table(ODD).limit(0)).count() == 0


def test_prefixes_of_linked_sets_meet_under_every_order(table):
    """Similar sets share a token of the first prefix and a mark of each other order."""
    rng = random.Random(9)
    bases = [prose(rng, rng.randrange(8, 300)) for _ in range(40)]
    texts = [t for b in bases for t in (b, edited(rng, b, rng.randrange(0, 4)))]
    frequency = np.array([rng.randrange(256) for _ in range(op12_ngram_join.CELLS)], np.uint8)
    found = op12_ngram_join.prefixes(table(texts), (frequency, 40), 4, 85).collect()
    by_id = {bytes(r.name): r for r in found}
    names = {}
    for t in texts:
        sh, _, at = op12_ngram_join._sets([t.encode()], 4)
        names[t] = op12_ngram_join._names(sh, at)[0].tobytes()
    linked = 0
    for a, b in itertools.combinations(sorted(set(texts)), 2):
        x, y = shingle_set(a), shingle_set(b)
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            linked += 1
            r, s = by_id[names[a]], by_id[names[b]]
            assert all(set(r[c]) & set(s[c]) for c in ("tokens", "mark1", "mark2"))
            assert r.plain == sum(frequency[(t % 2**64) >> 44] <= 40 for t in r.tokens)
            assert len(r.tokens) == len(x) - -(-len(x) * 85 // 100) + 1
    assert linked > 10


def test_a_hot_bucket_takes_three_rounds(spark, table, monkeypatch):
    """The number of confirmations does not grow with a bucket."""
    calls = []
    real = op12_ngram_join.verified
    monkeypatch.setattr(op12_ngram_join, "verified", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(op12_ngram_join, "SLICE", 7)
    rng = random.Random(5)
    line = prose(rng, 30)
    texts = [f"{line} {prose(rng, rng.randrange(0, 6))}" for _ in range(150)]
    got = {r.doc_id: r.component_id for r in op12_ngram_join.ngram_join(table(texts)).collect()}
    assert got == brute_links(list(enumerate(texts)), 85) and len(calls) <= 3


def test_pipeline_stages_on_odd_rows(spark, table):
    """Every stage bears nulls, empty texts, repeated rows, ties and extra columns of any name, and keeps its columns."""
    import corpus_pipeline

    rng = random.Random(21)
    text = "Some ordinary words in a plain sentence, and others after them: " + prose(rng, 120)
    rows = [*enumerate(ODD), (50, text), (50, text), (51, text.upper()), (52, text + " end"), (None, text), (53, prose(rng, 80)), (53, prose(rng, 90))]
    docs = table(rows).selectExpr("*", "doc_id AS gone_id", "n_chars AS mark", "text AS lead", "source AS row", "1 AS n_words")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, f"{DATA}/sf0.001")
            kept = out.collect()
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
                assert all(r.lead in (r.text, r.lead) for r in kept)
                now = spark.createDataFrame(kept, docs.schema)
            ids = [r.doc_id for r in kept]
            if empty:
                assert not ids
            elif name == "language_id":
                assert ids.count(50) == 2 and ids.count(53) == 2 and None in ids and 0 not in ids and 1 not in ids and 2 not in ids
            elif name == "near_dedup":  # both rows of the least id of a group stay, and so does what has no id
                assert ids.count(50) == 2 and 51 not in ids and 52 not in ids and None in ids and ids.count(53) == 2
            else:
                assert ids.count(50) == 2 and ids.count(53) == 2
