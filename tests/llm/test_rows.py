"""Operators that work row by row: exact results, and odd rows."""

import hashlib
import random
import time
import re

import pytest
import regex
from conftest import DATA, plain

from .conftest import ODD, prose

pytest.importorskip("public_tokenizers")
import public_tokenizers as PT  # noqa: E402

from arborlake.llm import op1_quality_rules, op2_token_counts, op4_decontamination, op5_quality_crf, op6_license_scans, op7_language_id, op8_byte_bpe, op9_url_filters, queries  # noqa: E402

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, duck, name):
    out = queries.queries()[name](spark, f"{DATA}/sf0.001")
    columns, rows = duck(SQL[name], f"{DATA}/sf0.001")
    assert plain(out.columns, out.collect()) == plain(columns, rows)


def test_quality_rules_on_odd_rows(table):
    docs = table(ODD).union(table([(None, "a " * 60), (3, "dup"), (3, "dup")]))
    got = op1_quality_rules.quality_rules(docs).collect()
    assert len(got) == len(ODD) + 3 and sum(r.doc_id == 3 for r in got) == 3
    by = {r.doc_id: r for r in got}
    assert by[0].n_words == 0 and by[0].base_failed and not by[0].kept
    assert by[None].n_repeat_words == 60 and by[None].base_failed
    assert by[7].n_repeat_words == 1200 and by[9].n_dup_lines == 49
    assert op1_quality_rules.quality_rules(table(ODD).limit(0)).count() == 0


def test_hosts_are_shrunk(spark):
    """A host of one failed document is drawn to the others' rate; a host of many is not."""
    rows = [("big", True)] * 300 + [("tiny", True)] + [(f"good{i}", False) for i in range(40) for _ in range(20)] + [(None, True)] * 5
    figures = spark.createDataFrame(rows, "host string, rule_failed boolean")
    got = {r.host: r for r in op1_quality_rules.host_verdicts(figures).collect()}
    assert got["big"].host_rejected and got["big"].host_rate > 0.99 and got["tiny"].host_rate < 1 and None not in got


def test_token_counts(table):
    from tokenizers import Tokenizer

    path = PT.path("word_bpe_49k.json")
    rng = random.Random(1)
    parts = ["a", "B", "\x1c", "\x85", " ", "É", "é", "İ", "ς", "ﬁ", "½", "中", "😀", "'s", "'LL", "12", " ", "\n", "<|endoftext|>", "<|end", "#", "__", "ǅ", "aaaa", "the ", "\x00"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in op2_token_counts.token_counts(table(texts), path).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)
        assert got[i].n_bytes == len((t or "").encode())


def test_merging_takes_all_lowest_pairs_at_once():
    """Against merging one lowest-rank pair at a time from the left."""
    c = op2_token_counts.RankCounter(PT.path("word_bpe_49k.json"))
    ranks = {(int(k) // c.size, int(k) % c.size): (int(r), int(c.made[r])) for k, r in zip(c.key, c.rank)}
    rng = random.Random(2)
    words = ["".join(rng.choice("aabcestr") for _ in range(rng.randrange(1, 14))) for _ in range(300)]

    def slow(w):
        s = [int(c.inner[b]) for b in w.encode()]
        s[-1] = int(c.last[w.encode()[-1]])
        while True:
            best = min((ranks[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks) if any(p in ranks for p in zip(s, s[1:])) else None
            if not best:
                return len(s)
            i = best[1]
            s[i : i + 2] = [ranks[s[i], s[i + 1]][1]]

    assert c.merged_lengths(words).tolist() == [slow(w) for w in words]
    assert [c.merged_length(w) for w in words] == c.merged_lengths(words).tolist()


def test_long_words_take_the_same_steps():
    """Words beyond LONG against the library, and how long a word of a million letters takes."""
    from tokenizers import Tokenizer

    path = PT.path("word_bpe_49k.json")
    c, library, rng = op2_token_counts.RankCounter(path), Tokenizer.from_file(path), random.Random(3)
    words = ["a" * 513, "a" * 5000, "ab" * 700, "the" * 999, "中é" * 400]
    words += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (op2_token_counts.LONG, op2_token_counts.LONG + 1, 20_000)]
    for w in words:
        assert c.counts([f"{w} x {w}"]) == [len(library.encode(f"{w} x {w}", add_special_tokens=False).ids)]
    assert not [w for w in c.memo if len(w) > op2_token_counts.LONG]
    began = time.perf_counter()
    c.counts(["".join(rng.choice("etaoinshr") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 60


def test_byte_bpe_round_trip(spark, table):
    path = PT.path("byte_bpe_multi_50k.tiktoken")
    enc = op8_byte_bpe.encoding(path, PT.PATTERN)
    long = prose(random.Random(3), 90_000) + " " * 50 + "\n\nend 12ab"
    texts = [*ODD, "it's we'll 'tis", "  two  spaces ", long]
    encoded = op8_byte_bpe.encode(table(texts), path, PT.PATTERN)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    back = {r.doc_id: bytes(r.decoded) for r in op8_byte_bpe.decode(encoded, path, PT.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert ids[i] == enc.encode_ordinary(t or "") and back[i] == (t or "").encode()
    assert len(list(op8_byte_bpe.pieces(long, 1000))) > 100 and "".join(op8_byte_bpe.pieces(long, 1000)) == long
    assert [x for p in op8_byte_bpe.pieces(long, 1000) for x in enc.encode_ordinary(p)] == ids[len(texts) - 1]
    d = {r.doc_id: r for r in op8_byte_bpe.digests(op8_byte_bpe.encode(table(texts), path, PT.PATTERN, decode_too=True)).collect()}
    assert d[0].n_tokens == 0 and d[0].ids_sha256 == d[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert d[4].ids_sha256 == hashlib.sha256(",".join(map(str, ids[4])).encode()).hexdigest()
    assert op8_byte_bpe.encode(table(ODD).limit(0), path, PT.PATTERN).count() == 0


def test_byte_bpe_bears_long_runs(table, monkeypatch):
    """White space of any length; with small limits, texts of all kinds of runs give the library's ids."""
    path = PT.path("byte_bpe_multi_50k.tiktoken")
    enc, whole = op8_byte_bpe.encoding(path, PT.PATTERN), op8_byte_bpe.encoding(path, op8_byte_bpe.WHOLE)
    texts = [f"a{ch * (2_000_000 // len(ch))}{tail}" for ch in (" ", "\t", "\n", " \n") for tail in ("", "b 1")]
    got = {r.doc_id: r.ids for r in op8_byte_bpe.encode(table(texts), path, PT.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [x for m in regex.findall(PT.PATTERN, t) for x in whole.encode_ordinary(m)]
    monkeypatch.setattr(op8_byte_bpe, "RUN_CHARS", 6)
    monkeypatch.setattr(op8_byte_bpe, "PIECE_CHARS", 10)
    monkeypatch.setattr(op8_byte_bpe, "_RUN", regex.compile(r"(?<!\s)\s{6,}+"))
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice([" ", "  ", "\n", "a", "b1", "!", "'s", "é", " \u3000"]) for _ in range(rng.randrange(60)))
        assert op8_byte_bpe.encode_text(path, PT.PATTERN, t) == enc.encode_ordinary(t), repr(t)


def test_language_id(spark, table):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = op7_language_id.query(spark, f"{DATA}/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    names, prototypes = op7_language_id.train(docs)
    got = {r.doc_id: r for r in op7_language_id.predict(table(ODD), names, prototypes).collect()}
    assert len(got) == len(ODD) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[4].lang_pred in names
    nothing = op7_language_id.identify(table(ODD).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert op7_language_id.identify(table(ODD).limit(0)).count() == 0


def test_profiles_against_brute_force(table):
    """Bind, permute, bundle and cosine one trigram at a time; in small pieces and slices; beyond the basic planes."""
    import numpy as np

    o = op7_language_id
    profiles, rng = o.Profiles(64), random.Random(1)

    def slow(text):
        c = [int(profiles.codes[ord(x)]) for x in f"\n{text.lower()}\n"]
        out = np.zeros(64)
        for a, b, d in zip(c, c[1:], c[2:]):
            out += profiles.places[0][a].astype(int) * profiles.places[1][b] * profiles.places[2][d] if b else 0
        return out

    texts = ["", " ", "1.", "a", "ab c", "Ünï ß中文", "\U00030001\U00031350", "İstanbul ǅ", "x" * 50, *("".join(rng.choice("abcdeé 中文字\n.") for _ in range(rng.randrange(200))) for _ in range(200))]
    want = np.array([slow(t) for t in texts])
    for piece, size in ((1 << 19, 4096), (7, 5)):
        o.PIECE, before = piece, o.PIECE
        o.SLICE, slice_ = size, o.SLICE
        try:
            got, some = profiles.vectors(texts)
        finally:
            o.PIECE, o.SLICE = before, slice_
        assert (got == want).all() and some.tolist() == [any(x.isalpha() for x in t.lower()) for t in texts]
    names, prototypes = ["a", "b"], o.unit(o.Profiles().vectors(["the cat sat", "中文字"])[0]).astype(np.float32)
    said = {r.doc_id: r for r in o.predict(table(texts), names, prototypes).collect()}
    full = o.unit(o.Profiles().vectors(texts)[0]) @ prototypes.T
    for i, t in enumerate(texts):
        best = full[i].argmax()
        assert said[i].lang_pred == (names[best] if any(x.isalpha() for x in t) else "und")
        assert abs(said[i].score - max(0, full[i][best])) < 1e-4
    assert said[6].lang_pred != "und"


def test_languages_of_long_documents_are_learnt(spark):
    rows = [(i, lang, f"{word} " * 30_000) for i, (lang, word) in enumerate([("en", "thing"), ("de", "schön")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    assert op7_language_id.train(docs, per_language=30)[0] == ["de", "en"]


def test_quality_field(spark, table):
    from pyspark.sql import functions as F

    where = f"{DATA}/sf0.1"
    out = op5_quality_crf.query(spark, where).join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out")
    good, bad = (out.where(F.col("quality") == q).agg(F.avg((F.col("predicted") == q).cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.97 and bad > 0.9
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = op5_quality_crf.fit(docs, labels)
    got = {r.doc_id: r.score for r in op5_quality_crf.score_documents(table(ODD), model).collect()}
    assert len(got) == len(ODD) and got[0] == got[1] == got[2] == 0 and all(0 <= s <= 1 for s in got.values())
    none = op5_quality_crf.fit(docs, labels.where("quality = 1"))
    assert {r.score for r in op5_quality_crf.score_documents(table(["a", ""]), none).collect()} == {0.5, 0.0}


def test_quality_field_learns_from_all_lines():
    """Documents that differ only behind their first 400 lines are told apart."""
    rng = random.Random(2)
    head = "\n".join("It was a day like all others." for _ in range(450))
    sample = [(head + "\n" + "\n".join(("$$$ BUY NOW!!! ### " if y == 0 else "The evening was calm and they talked of home. ") + str(rng.random()) for _ in range(200)), y) for y in (0, 1) for _ in range(10)]
    model = op5_quality_crf.train(sample, rounds=60)
    got = op5_quality_crf.scores(model, [t.encode() for t, _ in sample])
    assert min(s for s, (_, y) in zip(got, sample) if y) > max(s for s, (_, y) in zip(got, sample) if not y)


def test_forward_backward_against_all_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    score, tie = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    good, pair = op5_quality_crf.marginals(score, np.ones((1, 5), bool), tie, np.ones(1))
    weights = {y: np.exp(sum(s * v for s, v in zip(score[0], y)) + sum(tie[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=5)}
    z = sum(weights.values())
    assert np.allclose(good[0], [sum(w for y, w in weights.items() if y[t]) / z for t in range(5)])
    assert np.allclose(pair, [[sum(w * sum((p, q) == (a, b) for p, q in zip(y, y[1:])) for y, w in weights.items()) / z for b in (0, 1)] for a in (0, 1)])


def test_license_scan(table):
    texts = [t for v in op6_license_scans.TEMPLATES.values() for t in v]
    want = [f for f, v in op6_license_scans.TEMPLATES.items() for _ in v]
    got = {r.doc_id: r for r in op6_license_scans.license_scan(table(texts + ODD + ["prose first\nReleased under the MIT License.\nmore", "Her driver's license was lost.\nlicensed licensed"])).collect()}
    assert [got[i].families for i in range(len(texts))] == [[f] for f in want]
    n = len(texts) + len(ODD)
    assert got[n].families == ["mit"] and got[n].n_licensed == 1 and got[n].n_paragraphs == 3
    assert got[n + 1].families == [] and got[n + 1].n_unknown == 2
    assert got[len(texts)].n_paragraphs == 0
    twice = op6_license_scans.license_scan(table([(1, texts[0]), (1, texts[0]), (None, texts[0]), (1, "other")])).collect()
    assert sorted(r.n_licensed for r in twice) == [0, 1, 1, 1]
    assert op6_license_scans.license_scan(table(ODD).limit(0)).count() == 0


def test_license_spellings(table):
    """Lines without a cue word are judged by their words, whatever stands between them; prose stays out."""
    o = op6_license_scans
    same = {"This text is available under CC-BY-SA 4.0.": "This text is available under CC BY-SA 4.0.", "CC-BY 4.0": "CC BY 4.0", "Released under BSD 3-Clause.": None, "Released into the public-domain under the Un-License": None, "Released into the public-domain": "Released into the public domain"}
    texts = [*same, *(x for x in same.values() if x), "He walked under the bridge.", "It is released."]
    got = {t: r for t, r in zip(texts, sorted(o.license_scan(table(texts)).collect()))}
    for t, cued in same.items():
        assert got[t].n_licensed + got[t].n_unknown == 1, t
        assert not cued or got[t][2:] == got[cued][2:], t
    assert got["This text is available under CC-BY-SA 4.0."].families == ["cc-by-sa"]
    assert got["He walked under the bridge."].n_unknown == got["It is released."].n_unknown == 0


def test_license_families_that_are_not_known(table):
    """Other licences are unknown; so are variants of known ones. Rates on the notices that the model has not learnt from."""
    o = op6_license_scans
    others = [*o.HELD_OTHERS, *o.OTHERS, "Distributed under the Boost Software License.", "licensed under the EUPL", "SPDX-License-Identifier: CC-BY-ND-4.0", "of this software and associated documentation files"]
    held = [(t, f) for f, texts in o.HELD.items() for t in texts]
    texts = [*others, *(t for t, _ in held), "SPDX-License-Identifier: MPL-2.0"]
    got = [r.families for r in sorted(o.license_scan(table(texts)).collect())]
    assert all(f == [] for f in got[: len(others)])
    said = got[len(others) : -1]
    assert all(g in ([], [f]) for g, (_, f) in zip(said, held)) and sum(g == [f] for g, (_, f) in zip(said, held)) >= 0.75 * len(held)
    assert got[-1] == ["mpl"]


def test_license_cues():
    """Every eight words in a row of a template hold a cue."""
    o = op6_license_scans
    for t in (t for v in o.TEMPLATES.values() for t in v):
        w = re.findall("[a-z0-9]+", t.lower())
        assert all(re.search(o.CUE_PATTERN, " ".join(w[i : i + 8])) for i in range(max(1, len(w) - 7))), t
    assert not re.search(o.CUE_PATTERN, "mitigating circumstances under the bridge")


def test_url_filter(spark):
    urls = ["https://a.com", "https://A.com/x", "http://www.example.com/en/1?q=://", "http://example.com/en/", "http://x.example.com/en/2", "http://b.net/fr/1#t", "http://notexample.com/en/", None, "", "no scheme/en/", "https://", "http://casino-win.example.org/win/bonus", "http://library.example.org/docs/intro", "http://ünï.example.org/ä"]
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in enumerate(urls)], "page_id bigint, url string, rule string, host int")
    got = [tuple(r)[1:5] for r in op9_url_filter_rows(df)]
    assert got[0] == ("a.com", "", None, got[0][3])
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("example.com/en/", "block") and got[4][2:] == ("example.com/en/", "block")
    assert got[5] == ("b.net", "/fr/1", "net/fr/", "block") and got[6][2:] == ("com/", "allow")
    assert all(got[i][:3] == ("", "", None) for i in (7, 8, 9, 10)) and got[11][3] == "block" and got[12][3] == "allow"
    rows = op9_url_filters.labelled_urls()
    from pyspark.sql import functions as F

    train = spark.createDataFrame([(i, f"http://{h}{p}", y) for i, (h, p, y) in enumerate(rows)], "page_id bigint, url string, y int")
    said = op9_url_filters.url_filter(train, rules=[]).join(train, "page_id")
    assert said.agg(F.avg((F.col("verdict") == F.when(F.col("y") == 1, "block").otherwise("allow")).cast("int"))).first()[0] > 0.99
    # hosts that are not in the table
    block = ["grandcasino.example.org/win", "online-poker.example.org", "xxx-porn.example.org/adult", "cheap-viagra.example.org/buy-now", "spam-links.example.org"]
    allow = ["botany.example.org/docs", "sailing-club.example.org/about", "dictionary.example.org", "chemistry-notes.example.org/articles/3", "wanderings.example.org/2020/05", "q.example.org/"]
    new = spark.createDataFrame([(i, f"https://{u}") for i, u in enumerate(block + allow)], "page_id bigint, url string")
    said = [r.verdict for r in op9_url_filters.url_filter(new).orderBy("page_id").collect()]
    assert said[: len(block)].count("block") >= 4 and said[len(block) :].count("allow") == len(allow)


def op9_url_filter_rows(df):
    return op9_url_filters.url_filter(df).orderBy("page_id").collect()


def test_decontamination(spark, table):
    rng = random.Random(5)
    items = [prose(rng, n) for n in (30, 13, 12, 1, 2, 40, 14)] + ["", None, " .,", "30 words"]
    items.append(items[0])
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(None, items[5], 1)], "item_id bigint, text string, spans int")
    texts = [*ODD, *(" ".join(filter(None, [prose(rng, rng.randrange(30)), rng.choice(items) or "", prose(rng, rng.randrange(200)), (rng.choice(items) or "")[5:]])).replace(" ", rng.choice([" ", ", ", "\n"])).title() for _ in range(60))]
    found = op4_decontamination.judged(op4_decontamination.contaminated_spans(table(texts), bench))
    got = {r.doc_id: r for r in found.collect()}
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for d, t in enumerate(texts):
        w, hit, names = words(t), set(), set()
        for i, item in enumerate(items):
            b = words(item)
            k = min(13, len(b))
            wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in wins:
                    hit.update(range(j, j + k))
                    names.add(str(i))
        assert (got[d].n_words, got[d].n_hit, got[d].items) == (len(w), len(hit), sorted(names)), d
        assert got[d].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    old, op4_decontamination.BLOCK_CHARS = op4_decontamination.BLOCK_CHARS, 60  # several blocks give the same
    try:
        again = {r.doc_id: r for r in op4_decontamination.judged(op4_decontamination.contaminated_spans(table(texts), bench)).collect()}
    finally:
        op4_decontamination.BLOCK_CHARS = old
    assert again == got
    assert op4_decontamination.contaminated_spans(table(texts), bench.limit(0)).where("size(items) > 0").count() == 0
    assert op4_decontamination.contaminated_spans(table(texts).limit(0), bench).count() == 0


@pytest.mark.parametrize("run", [1_000, 30_000, 65_535, 65_536, 70_000])
def test_byte_bpe_takes_time_in_proportion_to_blanks(run):
    """2 MB of words between blanks of any length, encoded as the library does."""
    path = PT.path("byte_bpe_multi_50k.tiktoken")
    enc = op8_byte_bpe.encoding(path, PT.PATTERN)
    some = "word, 12" + " " * run + "a\n" + "\t" * run + "\n Z"
    text = some * (2_000_000 // len(some) + 1)
    began = time.perf_counter()
    ids = op8_byte_bpe.encode_text(path, PT.PATTERN, text)
    took = time.perf_counter() - began
    assert took < 4 and enc.decode_bytes(ids) == text.encode()
    if run < 60_000:
        assert ids == enc.encode_ordinary(text)
