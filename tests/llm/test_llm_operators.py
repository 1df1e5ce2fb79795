"""Every operator on the awkward table, on an empty one, and against brute force."""

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import llm_cases as cases  # noqa: E402

from tagloom.llm import (  # noqa: E402
    common, fingerprint, language, licenses, lines, mixing, ngram_join, packing, quality, repeats, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.docs(spark, False)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


def keyed(df):
    """doc_id -> rows; equal documents have equal rows."""
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def plain():
    return [(r[0], r[1]) for r in cases.rows()]


# --- shared helpers ------------------------------------------------------------------------


def test_words_of_bytes_and_columns_agree(spark):
    texts = [t or "" for t in cases.texts()]
    found = list(common.word_hashes(texts))
    assert [len(h) for h in found] == [len(WORD.findall(t)) for t in texts]
    a, b = common.word_hashes(["x Foo é y foo", "foo"])
    assert a[1] == a[3] == b[0] and len(set(a.tolist())) == 3
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(common.n_words(F.col("text")).alias("n"))
    assert [r.n for r in df.collect()] == [len(WORD.findall(t)) for t in texts]


def test_components_of_long_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(300)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 0 for k in range(1, 61)} | {901: 900} | {200 + k: 100 for k in range(300)}
    assert got == want


def test_mask_lets_every_wanted_key_through(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("k"))
    mask = common.mask_of(rows, "k")
    keys = np.array([r.k for r in rows.collect()], np.int64)
    other = np.array([r.k for r in spark.range(10**6, 10**6 + 5000).select(F.xxhash64("id").alias("k")).collect()], np.int64)
    assert common.in_mask(mask, keys).all() and common.in_mask(mask, other).mean() < 0.01


def test_numbers_are_gapless(spark):
    got = common.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"], "n").collect()
    assert all(r.v == r.n for r in got) and len(got) == 1000


# --- 1 quality -----------------------------------------------------------------------------


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered.update(range(i, i + 5))
    own = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered))


def test_quality_counts(docs, empty):
    got = keyed(quality.verdicts(docs))
    for doc_id, text in plain():
        for r in got[doc_id]:
            n = brute_counts(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
            assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert not (r.base_failed and r.kept)
    assert sum(map(len, got.values())) == len(plain())
    assert quality.verdicts(empty).count() == 0
    assert quality.keep(docs).columns == docs.columns


def test_quality_rejects_outliers_like_numpy(spark):
    rng = random.Random(3)
    rows = [(k, cases.sentence(rng, rng.randint(50, 300)), "en", "s") for k in range(900)]
    rows += [(1000 + k, " ".join(w + "###" for w in cases.sentence(rng, 120).split()), "en", "s") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert all(not got[k].kept for k in range(1000, 1100))
    assert sum(got[k].kept for k in range(900)) >= 898
    # the same concentration steps in numpy end in the same distances
    x = np.array([[np.log((r.word_chars + 250) / (r.n_words + 50)), np.log((r.n_symbols + 3) / (r.word_chars + 1000)),
                   np.log((r.n_dup_lines + 3) / (1 + 30)), np.log((r.n_repeat_words + 10) / (r.n_words + 200))]
                  for r in got.values()])
    floor = np.array(quality.FLOOR)
    c = np.median(x, 0)
    d = (((x - c) / (1.4826 * np.median(abs(x - c), 0) + floor)) ** 2).sum(1)
    p = 4
    widen = quality.SUPPORT / quality.chi2_cdf(quality.chi2_quantile(quality.SUPPORT, p), p + 2)
    for _ in range(quality.STEPS):
        cell = np.floor(16 * np.log2(d + 1e-9))
        bound = np.sort(cell)[int(np.ceil(quality.SUPPORT * len(d))) - 1]
        near = x[cell <= bound]
        scatter = np.cov(near.T, bias=True) * widen + np.diag(floor**2)
        y = x - near.mean(0)
        d = (y @ np.linalg.inv(scatter) * y).sum(1)
    mine = np.array([r.distance for r in got.values()])
    assert np.abs(mine - d).max() < 0.05 * (1 + d.max())


def test_quality_small_sources_use_their_whole_level(spark):
    rng = random.Random(4)
    text = lambda: cases.sentence(rng, rng.randint(50, 300))
    odd = lambda: " ".join(w + "###" for w in cases.sentence(rng, 120).split())
    rows = [(k, text(), "en", "A") for k in range(600)]
    rows += [(1000 + k, text(), "en", "B") for k in range(40)] + [(1100, odd(), "en", "B")]  # small beside a large source
    rows += [(1200 + k, text(), None, "C") for k in range(20)] + [(1300, odd(), None, "C")]  # a rare language
    rows += [(2000 + k, text(), "fr", "D") for k in range(190)] + [(2300 + k, "too short", "fr", "D") for k in range(20)]
    rows += [(2400, odd(), "fr", "D")]  # enough rows, but not enough of them pass
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert len(got) == len(rows)
    assert not any(got[k].kept for k in (1100, 1300, 2400))
    good = [k for k, *_ in rows if k not in (1100, 1300, 2400) and not 2300 <= k < 2320]
    assert sum(got[k].kept for k in good) >= len(good) - 3


# --- 2 licences ----------------------------------------------------------------------------


def test_licences_and_inheritance(spark):
    files = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/b/x.py", "code"), (3, "p/a/COPYING", "Licensed under CC BY-NC 4.0."),
        (4, "p/a/y.py", "# Licensed under the Apache License, Version 2.0.\nx = 1"), (5, "q/z.py", "code"), (6, None, "code"),
        (7, "p/c/d/e/f.txt", None), (8, "p/readme", "the work of the license is long and the version of under this is of no use " * 5),
        (7, "p/c/d/e/f.txt", None),
    ]
    df = spark.createDataFrame(files, "file long, path string, text string")
    got = {r.file: (r.own_licence, r.licence, r.licence_dir, r.levels) for r in licenses.scan(df).collect()}
    assert got == {
        1: ("MIT", "MIT", None, None), 2: (None, "CC-BY-NC-4.0", "p/a", 1), 3: ("CC-BY-NC-4.0",) * 2 + (None, None),
        4: ("Apache-2.0", "Apache-2.0", None, None), 5: (None,) * 4, 6: (None,) * 4, 7: (None, "MIT", "p", 3), 8: (None, "MIT", "p", 0),
    }
    assert licenses.scan(df.limit(0)).count() == 0 and licenses.scan(df).count() == len(files)


def test_licences_give_a_row_for_each_row(spark):
    """Repeated ids and urls, ties, clashing columns, a very long text, empty tables."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    pages = [(1, "http://a.b/c/d", mit, "x"), (1, "http://a.b/c/d", "none", "x"), (1, "http://a.b/c/d", apache, None), (None, None, None, "y")]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string, licence string")
    texts = [(1, apache, "s", 1), (1, apache, "s", 1), (1, None, None, None), (2, "word " * 300_000 + ".\n" + mit, "s", 0), (None, "", "", 2)]
    texts = spark.createDataFrame(texts, "doc_id long, text string, source string, dir long")
    got = licenses.query(pages, texts).collect()
    assert len(got) == 9
    # a tie in a directory goes to the first by name
    assert sorted(str(r.licence) for r in got if r.origin == "pages") == ["Apache-2.0", "Apache-2.0", "MIT", "None"]
    assert sorted((str(r.file), str(r.own_licence)) for r in got if r.origin == "documents") == [
        ("1", "Apache-2.0"), ("1", "Apache-2.0"), ("1", "None"), ("2", "MIT"), ("None", "None")]
    assert licenses.query(pages.limit(0), texts.limit(0)).count() == 0
    assert licenses.query(pages.limit(0), texts).count() == 5


def test_licence_cosine_by_hand(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma gamma")], "file long, text string")
    got = {r.file: r for r in licenses.own_licences(df, {"L": ["alpha beta"]}, 0.9).collect()}
    assert got[1].licence == "L" and abs(got[1].score - 1) < 1e-9
    a, b, rare = (np.log(3 / 3) + 1, np.log(3 / 2) + 1, np.log(3 / 2) + 1)
    want = a * a / np.hypot(a, b) / np.hypot(a, (1 + np.log(2)) * rare)
    assert got[2].licence is None and abs(got[2].score - want) < 1e-9


def test_licences_of_pages_and_documents(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d", "<p>Released under the MIT License.</p>"), (2, "http://a.b/c/e", "<p>x</p>")],
                                  "page_id long, url string, html string")
    texts = spark.createDataFrame([(1, "one\nLicensed under CC BY-SA 4.0.\ntwo", "s"), (2, "none", "s"), (3, "Released under the MIT License.", None), (4, None, "s")],
                                  "doc_id long, text string, source string")
    got = {(r.origin, r.file): (r.own_licence, r.licence) for r in licenses.query(pages, texts).collect()}
    assert got == {
        ("pages", "1"): ("MIT", "MIT"), ("pages", "2"): (None, "MIT"), ("documents", "1"): ("CC-BY-SA-4.0",) * 2,
        ("documents", "2"): (None, None), ("documents", "3"): ("MIT", "MIT"), ("documents", "4"): (None, None),
    }


def test_licences_of_roots_and_home_pages(spark):
    files = [(1, "LICENSE", "Released under the MIT License."), (2, "src/a/x.py", "code"), (3, "y.py", "code"), (4, "src/COPYING", "Licensed under CC BY 4.0."),
             (5, "lib/z.py", "code")]
    got = {r.file: (r.licence, r.licence_dir, r.levels) for r in licenses.scan(spark.createDataFrame(files, "file long, path string, text string")).collect()}
    assert got == {1: ("MIT", None, None), 2: ("CC-BY-4.0", "src", 1), 3: ("MIT", "", 0), 4: ("CC-BY-4.0", None, None), 5: ("MIT", "", 1)}
    pages = [(1, "https://one.org/", "Released under the MIT License."), (2, "https://one.org/a/b", "x"), (3, "https://two.org", "x"), (4, "https://two.org/?q=1", "x")]
    texts = spark.createDataFrame([], "doc_id long, text string, source string")
    got = {r.file: r.licence for r in licenses.query(spark.createDataFrame(pages, "page_id long, url string, html string"), texts).collect()}
    assert got == {"1": "MIT", "2": "MIT", "3": None, "4": None}


def test_licences_with_their_versions(spark):
    work = "This work is licensed under "
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n" \
        "2. Redistributions in binary form must reproduce the above copyright notice.\n"
    cases_ = {
        work + "the GNU General Public License, version 2.": "GPL-2.0", work + "the GNU General Public License, version 3.": "GPL-3.0",
        work + "the GNU General Public License, version 7.": None, work + "the GNU Lesser General Public License, version 2.1.": "LGPL-2.1",
        work + "the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under CC BY 3.0.": "CC-BY-3.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        work + "a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0", bsd: "BSD-2-Clause",
        bsd + "3. Neither the name of the copyright holder may be used.": "BSD-3-Clause",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or": "GPL-2.0",
    }
    filler = [(100 + k, cases.sentence(random.Random(k), 20)) for k in range(200)]
    df = spark.createDataFrame([*enumerate(cases_), *filler], "file long, text string")
    got = {r.file: r.licence for r in licenses.own_licences(df).collect()}
    assert [got[k] for k in range(len(cases_))] == list(cases_.values())


# --- 3 n-gram join -------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall(lower(text))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(a)].append(doc_id)
    return [(rows[a][0], len(sets[a]), min(least[find(a)], default=None) if sets[a] else rows[a][0]) for a in range(len(rows))]


def test_ngram_join_equals_all_pairs(docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()), key=repr)
    assert got == sorted(brute_components(plain(), 4, 85), key=repr)
    assert ngram_join.join(empty).count() == 0


def test_ngram_join_of_random_families(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for family in range(12):
        base = cases.sentence(rng, rng.randint(5, 90)).split()
        for _ in range(15):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(["aa", "bb", "cc"]) if family % 2 else cases.sentence(rng, 1)
            rows.append((len(rows), " ".join(words[rng.randint(0, 3) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((4, 85), (2, 60)):
        monkeypatch.setattr(ngram_join, "TRIE_SETS", 128 if size == 4 else 3)  # families in one group, and in blocks
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df, size, percent).collect())
        assert got == sorted(brute_components(rows, size, percent))


def test_trie_walk_equals_plain_intersection():
    rng = np.random.default_rng(2)
    for _ in range(50):
        universe = rng.integers(0, 60, 40).astype(np.uint64)
        sets = [np.unique(rng.choice(universe, rng.integers(1, 30))) for _ in range(20)]
        probe = np.unique(rng.choice(universe, 15))
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 60 * len(np.union1d(s, probe))]
        assert sorted(ngram_join.walk(probe, list(enumerate(sets)), 60)) == want


# --- 4 repeats -----------------------------------------------------------------------------


def brute_repeats(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    times = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        under = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                under[i : i + length] = True
        kept = bytes(b for b, u in zip(d, under) if not u)
        spans = int(under[:1].sum()) + int((under[1:] & ~under[:-1]).sum())
        out.append((doc_id, len(d), int(under.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_all_windows(docs, empty, monkeypatch):
    got = [tuple(r) for r in repeats.query(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    want = sorted(brute_repeats(plain()), key=repr)
    assert sorted(got, key=repr) == want
    assert sum(w[2] for w in want) > 2000
    monkeypatch.setattr(repeats, "GROUP", 2)  # the way of large anchors gives the same
    got = [tuple(r) for r in repeats.query(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=repr) == want
    assert repeats.query(empty).count() == 0


def test_merge_equals_all_windows():
    rng = random.Random(1)
    for t in range(15):
        base = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(200, 330))) for _ in range(4)]
        found = []
        for _ in range(rng.randint(2, 12)):
            x = bytearray(rng.choice(base))
            if rng.random() < 0.8:
                p = rng.randrange(len(x))
                x[p : p + rng.randint(0, 3)] = b"zz"
            found.append(bytes(x))
        found += [b"a" * 310, b"a" * 250, b"ab" * 140] if t % 3 == 0 else []
        found = [s for s in found if len(s) >= 200]
        times = Counter(s[i : i + 200] for s in found for i in range(len(s) - 199))
        want = [[i for i in range(len(s) - 199) if times[s[i : i + 200]] > 1] for s in found]
        assert [list(g) for g in repeats.repeated_starts(found)] == want


# --- 5 toxicity ----------------------------------------------------------------------------


def test_toxicity_learns_a_pair(spark, empty):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(1500):
        words = cases.sentence(rng, 30).split()
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        words[:0] = ["Worthless"] * insult + ["groupies"] * group
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(insult and group)))
    df = spark.createDataFrame(rows + [(9001, None), (9002, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.query(df, marks).collect()}
    held = [k for k in range(1500) if crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in range(1500))
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.99
    assert got[9001].score == got[9002].score < 0.5
    assert toxicity.query(df, marks.limit(0)).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.query(empty, marks).count() == 0


# --- 6 packing -----------------------------------------------------------------------------


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.pack(docs, with_ids=True).collect()
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    by = keyed(packing.pack(docs, with_ids=True))
    for doc_id, text in plain():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset, bytes(r.ids)) for r in by[doc_id]})
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [p[1] for p in pieces[:-1]]))
        assert np.frombuffer(b"".join(p[5] for p in pieces), "<u4").tolist() == ids
        assert all(p[1] & (p[1] - 1) == 0 and p[1] <= 1024 and p[2] == crc32(p[5]) and p[3] == len(ids) and p[4] == 0 for p in pieces)
    assert packing.pack(empty).count() == 0


def test_fast_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    encoder, whole = packing.encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    assert encoder.fast is not None
    rng = random.Random(4)
    for k in range(3000):
        text = "".join(rng.choice(" \t\n\r\x0b\x1c\x85\xa0 a'sB1é²½·,.<|endoftext|>中​") for _ in range(rng.randint(0, 30)))
        text += "<|endoftext|> x" * (k % 50 == 0)
        assert encoder(text).tolist() == whole.encode(text, add_special_tokens=False).ids


# --- 7 lines -------------------------------------------------------------------------------


def test_lines_keep_one_of_a_group(spark, docs, empty):
    long = "the quick brown fox jumps over the lazy dog near the old river bank while many small birds sing loudly in the green trees"
    long = " ".join([long, long[::-1], long.upper()[::2]])
    rows = [
        (1, "First line\n\n" + long), (2, "first  LINE!\nother words here"), (3, long.replace("quick", "quikc", 1) + "\nFIRST line"),
        (4, None), (5, ""), (6, "...\n...\n"), (7, "total 12 of 40\ntotal 77 of 10\nend"), (2, "first  LINE!\nother words here"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.query(df).collect()}
    assert got == {
        1: (3, 0, "First line\n\n" + long), 2: (2, 1, "other words here"), 3: (2, 2, ""), 4: (0, 0, None), 5: (1, 0, ""),
        6: (3, 0, "...\n...\n"), 7: (3, 1, "total 12 of 40\nend"),
    }
    assert lines.dedup(docs).columns == docs.columns and lines.dedup(docs).count() == docs.count()
    assert lines.query(empty).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def check_lines(spark, rows):
    """``lines.query`` removes as many lines of each text as groups formed by edit similarity of all pairs."""
    occurrences = [(doc, " ".join(lines.normalised(x))) for doc, text in rows for x in text.split("\n")]
    names = sorted({x for _, x in occurrences})
    root = {x: x for x in names}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(names):
        for b in names[:i]:
            most = int((1 - lines.SIMILARITY) * max(len(a), len(b)) + 1e-9)
            apart = sum((Counter(a) - Counter(b)).values()), sum((Counter(b) - Counter(a)).values())
            if max(apart) <= most and find(a) != find(b) and edit_distance(a, b) <= most:
                root[find(a)] = find(b)
    seen, gone = set(), Counter()
    for doc, x in occurrences:
        gone[doc] += find(x) in seen
        seen.add(find(x))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in lines.query(df).collect()} == {k: gone[k] for k, _ in rows}
    return sum(gone.values())


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for k in range(60):
        own = []
        for _ in range(5):
            words = cases.sentence(random.Random(rng.randint(0, 15)), 30).split()
            if rng.random() < 0.6:
                words[rng.randrange(30)] = rng.choice(["of", "zz"])
            own.append(" ".join(words))
        rows.append((k, "\n".join(own)))
    assert check_lines(spark, rows) > 100


def test_short_lines_equal_brute_force(spark):
    rng = random.Random(18)
    rows = []
    for k in range(80):
        line = "".join(rng.choice("abcdeé龥") for _ in range(rng.randint(9, 18)))
        at, new = rng.randrange(len(line)), rng.choice("xyzö")
        rows.append((k, "\n".join([line, rng.choice([line[:at] + new + line[at + 1:], line[:at] + new + line[at:], line[:at] + line[at + 1:]])])))
    assert check_lines(spark, rows) > 60


def test_within_equals_edit_distance():
    rng = random.Random(38)
    for _ in range(400):
        a = "".join(rng.choice("ab龥") for _ in range(rng.randint(0, 90)))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
        b, d = "".join(b), edit_distance(a, "".join(b))
        assert lines.within(a, b, d) and not lines.within(a, b, d - 1)


def test_long_lines_of_one_group(spark):
    rng = random.Random(48)
    text = cases.sentence(rng, 9000)
    edited = text[:5000] + "zz" + text[5001:30000] + text[30007:]
    other = cases.sentence(rng, 9000)
    got = lines.query(spark.createDataFrame([(1, text), (2, edited), (3, other)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 1), (3, 0)]


def test_lines_find_edited_letters_and_words(spark):
    rng = random.Random(81)
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(n))
    rows, kinds = [], {}
    for k in range(600):
        words = [word(rng.randint(2, 9)) for _ in range(rng.randint(8, 40))]
        edited, kind, at = list(words), k % 4, rng.randrange(len(words))
        if kind == 0:  # a letter of any word
            i = rng.randrange(len(words[at]))
            edited[at] = words[at][:i] + "z" + words[at][i + 1:]
        elif kind == 1:
            edited[-1] += "s"
        elif kind == 2:  # a letter of the longest word
            at = max(range(len(words)), key=lambda i: len(words[i]))
            edited[at] = words[at][:-2] + "z" + words[at][-1]
        else:  # another word
            edited[at] = word(len(words[at]))
        if len(edited[at]) > 0.1 * len(" ".join(words)) and kind == 3:
            continue  # might be too far
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
        kinds[2 * k + 1] = kind
    got = {r.doc_id: r.n_removed for r in lines.query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(n for doc, n in got.items() if doc % 2 == 0)
    for kind in range(4):
        found = [got[doc] for doc in kinds if kinds[doc] == kind]
        assert len(found) > 100 and sum(found) >= 0.97 * len(found), (kind, sum(found), len(found))
    # a line without spaces has grams like any other
    plain = "一二" + "".join(chr(0x4E00 + 37 * i) for i in range(40))
    got = lines.query(spark.createDataFrame([(1, plain), (2, plain[:20] + "龥" + plain[21:])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 1)]


# --- 8 mixing ------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing_meets_its_targets(docs, empty):
    got = mixing.mix(docs).collect()
    sizes, takes = Counter(), Counter()
    names = defaultdict(set)
    for r in cases.rows():
        names[r[0]].add(r[3])
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, target = brute_targets(sizes), {}
    for r in got:
        (source,) = names[r.doc_id]
        takes[source] += r.taken
        target[source] = r.target
        assert r.source_size == sizes[source] and 0 <= r.taken <= 2 * r["size"]
    assert len(got) == len(cases.rows()) and all(abs(target[s] - want[s]) < 1e-6 * (1 + want[s]) for s in target)
    assert all(abs(takes[s] - want[s]) <= max(3, 0.05 * want[s]) for s in want)
    key = lambda rows: sorted(map(tuple, rows), key=repr)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(got)
    assert mixing.mix(empty).count() == 0 and mixing.repeat(empty).count() == 0
    assert mixing.repeat(docs).columns == docs.columns


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100}, {"a": 300}, {"a": 1000, "b": 100, None: 10}, {"a": 10, "b": 700, "c": 130, "d": 1000}])
def test_mixing_of_small_sources(spark, sizes):
    rows, rng = [], random.Random(3)
    for source, size in sizes.items():
        while size:
            n = rng.randint(1, min(size, 90))
            rows.append((len(rows), " ".join(["w"] * n), source))
            size -= n
    takes = Counter()
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert 0 <= r.taken <= 2 * r["size"]
        takes[rows[r.doc_id][2]] += r.taken
    for source, want in brute_targets(sizes).items():
        # blocks of a word each: three slots, or one in twenty
        assert abs(takes[source] - want) <= max(3, 0.05 * want), (source, takes[source], want)


def test_mixing_targets_with_full_sources(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 30, None: 5}, {"a": 7}, {"a": 0, "b": 3}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


# --- 9 fingerprints ------------------------------------------------------------------------


def test_fingerprints_and_edited_texts(docs, empty):
    rows = sorted((r for r in cases.rows() if r[0] is not None), key=lambda r: -r[0])
    got = keyed(fingerprint.fingerprints(docs))
    order = [(r[0], r[1] or "") for r in rows] + [(None, "a null id")]  # nulls are lowest
    shown = {}
    for k, (doc_id, text) in enumerate(order):
        following, half = order[(k + 1) % len(order)][1], len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        assert any(r.edited_sha256 == digest and r.n_chars == len(text) for r in got[doc_id])
        for r in got[doc_id]:
            assert shown.setdefault(text, r.fingerprint) == r.fingerprint
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(shown.values())) >= len(shown) - 3  # blank texts may agree
    assert sum(map(len, got.values())) == len(order)
    assert fingerprint.fingerprints(empty).count() == 0


def test_fingerprints_feel_order_and_edits(spark):
    rng = random.Random(6)
    words = cases.sentence(rng, 400).split()
    moved = words[200:] + words[:200]
    few = list(words)
    for k in range(0, 400, 40):
        few[k] = "new"
    rows = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(few)), (4, cases.sentence(rng, 400))]
    df = spark.createDataFrame(rows, "n long, text string")
    sig = {r.n: np.array(r.signature) for r in fingerprint.signatures(df, ["n"]).collect()}
    same = {k: (sig[1] == sig[k]).mean() for k in sig}
    assert same[1] == 1 and same[4] == 0 and same[3] > 0.5
    assert same[2] < 0.8  # all k-mers but two are shared, only their order differs


# --- 10 language ---------------------------------------------------------------------------


def test_language_by_family_then_pair(spark, empty):
    rng = random.Random(9)
    ends = {"en": ["ing", "the", "ough"], "de": ["ung", "sch", "keit"], "fr": ["eau", "oir", "que"], "es": ["cion", "ado", "ara"]}
    rows = []
    for k in range(400):
        lang = list(ends)[k % 4]
        rows.append((k, " ".join(rng.choice("abst") + rng.choice(ends[lang]) for _ in range(40)), lang if k % 40 < 36 else None))
    truth = {k: list(ends)[k % 4] for k in range(400)}
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.query(df).collect()}
    assert all(got[k].lang_pred == truth[k] and 0.5 < got[k].score <= 1 for k in truth)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1000, 1001, 1002))
    assert all(r.held_out == (crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    nothing = language.query(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert language.query(empty).count() == 0
    one = language.query(df.where("lang IS NULL OR lang = 'fr'"))
    assert {r.lang_pred for r in one.where("length(lang_pred) = 2").collect()} == {"fr"}


def test_operators_stand_the_awkward_table(spark, docs):
    assert language.query(docs).count() == toxicity.query(docs, spark.createDataFrame([(0, 1), (3, 0), (3, 1)], "doc_id long, toxic int")).count() == docs.count()


# --- the pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_join", "mixing", "packing"]
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, empty, "").count() == 0
    kept = {r.doc_id for r in pipeline.STAGES[0][1](spark, docs, "").collect()}
    good = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert kept == good
    once = pipeline.STAGES[2][1](spark, docs, "").collect()
    groups = brute_components(plain(), 5, 80)
    empties = {d for d, n, _ in groups if n == 0}
    assert len(once) == len({r.doc_id for r in once})
    assert {r.doc_id for r in once} == {c for _, n, c in groups if n} | empties
