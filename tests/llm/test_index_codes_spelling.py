"""The positional index, vector codes and spelling variants against brute force."""

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

from tagloom.llm import phrase_index, spelling, vector_codes  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.docs(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.docs(spark, False)


def plain():
    return [(r[0], r[1]) for r in cases.rows()]


# --- 11 positional index -------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for item_id, text in items:
        w = terms(text)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item_id)
    lengths = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = terms(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[g]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination(spark, docs, items):
    a = spark.createDataFrame(docs, "doc_id long, text string, term string, h long").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string, chunk int, at int")
    return phrase_index.query(a, b)


def test_positional_index_equals_brute_force(spark):
    rng = random.Random(5)
    common = ["the", "of", "Ünd", "7", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 11, 30, 62, 63, 64, 130])))) for k in range(40)]
    items += [(40, None), (41, ""), (42, "?! --"), (3, "the Second text of item three is here and it is quite long"), (None, items[5][1]), items[6]]
    items += [(43, items[7][1]), (44, "the of " * 20)]
    docs = []
    for k in range(150):
        w = [word() for _ in range(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 2)):
            part = terms(rng.choice(items)[1])
            if part:
                s = rng.randrange(len(part))
                at = rng.randint(0, len(w))
                w[at:at] = part[s : s + rng.choice([9, 10, 12, 40, 200])]
        docs.append((k, rng.choice([" ", "-", "\n", ", "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in w)))
    docs += [(200, None), (201, ""), (202, "the of " * 3000), docs[3], docs[3], (None, docs[4][1]), (203, items[9][1])]
    got = contamination(spark, [(*d, "x", 1) for d in docs], [(*i, 1, 2) for i in items])
    assert sorted([tuple(r)[:6] for r in got.collect()], key=repr) == brute_contamination(docs, items)


def test_positional_index_of_awkward_rows(spark, docs, empty):
    items = [(k, text) for k, (_, text) in enumerate(plain()) if k % 3 == 0]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = phrase_index.query(docs, bench)
    assert sorted([tuple(r)[:6] for r in got.collect()], key=repr) == brute_contamination(plain(), items)
    assert phrase_index.query(empty, bench).count() == 0
    clean = phrase_index.query(docs, bench.where("false")).collect()
    assert len(clean) == len(plain()) and not any(r.contaminated or r.n_items or r.n_hit for r in clean)
    assert {r.items_sha256 for r in clean} == {hashlib.sha256(b"").hexdigest()}


def test_index_holds_every_place(spark, docs):
    index = phrase_index.build(docs)
    held = index.select("term", F.explode(F.arrays_zip("texts", "places")).alias("p"))
    want = sum(len(terms(t)) for _, t in plain())
    assert held.count() == want
    places = Counter((r.p.texts, r.p.places) for r in held.collect())
    copies = Counter(t for _, t in plain() if t is not None)
    assert sum(places.values()) == sum(n * len(terms(t)) for t, n in copies.items())


def test_proximity_by_diagonals(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    w = item.split()
    docs = [(0, item), (1, " ".join(w[:3] + ["odd"] * 4 + w[3:])), (2, " ".join(w[:3] + ["odd"] * 300 + w[3:])), (3, "alpha beta"),
            (4, " ".join(reversed(w))), (5, "odd " * 50)]
    got = {r.doc_id: r for r in contamination(spark, [(*d, "x", 1) for d in docs], [(9, item, 1, 2)]).collect()}
    # the rarest words: least count, then first place
    counts = Counter(x for _, t in docs for x in terms(t))
    seeds = sorted(range(10), key=lambda k: (counts[w[k]], k))[: phrase_index.SEEDS]

    def close(text):
        met = defaultdict(set)
        for p, x in enumerate(terms(text)):
            for s in seeds:
                if w[s] == x:
                    k = (p - s) // phrase_index.SLACK
                    met[k].add(s), met[k - 1].add(s)
        return any(len(m) == len(seeds) for m in met.values())

    assert {k: r.n_near for k, r in got.items()} == {k: int(close(t)) for k, t in docs}
    assert got[1].n_near == 1 and not got[1].contaminated and got[2].n_near == 0 and got[0].contaminated


# --- 12 vector codes -----------------------------------------------------------------------


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, [int(np.floor(np.float64(x) * 256)) for x in v], y) for i, v, y in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    x = np.array([v for _, v, _ in good], np.int64).reshape(len(good), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    code, error = assign()
    error = error.sum(1)
    labels = Counter()
    for (_, _, y), e in zip(good, error):
        labels[y] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted([(i, "".join(f"{c:02x}" for c in cs), int(e), labels[y], digest) for (i, _, y), cs, e in zip(good, code, error)], key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, l int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1, 2) for i, v, y in rows], SCHEMA).repartition(3)


def test_vector_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(600):
        v = (rng.normal(0, 0.2, 64) if k % 3 else np.round(rng.normal(0, 0.02, 64), 2)).astype(np.float32).tolist()
        rows.append((k, v, [None, 1, 1, 2][k % 4]))
    rows += [rows[7], rows[7], (None, rows[9][1], 3), (601, None, 1), (602, [None] * 64, 1), (603, [float("nan")] * 64, 2),
             (604, [float("inf")] + [0.0] * 63, 2), (605, [], 2), (-5, [0.1] * 64, None)]
    rows += [(700 + k, [0.5] * 64, 1) for k in range(300)]  # one very frequent vector
    got = vector_codes.query(vectors(spark, rows)).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_codes(rows)


def test_vector_codes_of_few_rows_and_none(spark):
    few = [(k, [float(k % 2), *[0.0] * 30, 2.0], None) for k in range(5)]
    assert sorted(tuple(r) for r in vector_codes.query(vectors(spark, few)).collect()) == brute_codes(few)
    for rows in ([], [(1, None, 1)], [(1, [1.0] * 15, 1)]):
        none = vector_codes.query(vectors(spark, rows))
        assert none.count() == 0
        assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    mixed = few + [(9, [1.0] * 16, 1)]  # another length than the smallest id's
    assert len(vector_codes.query(vectors(spark, mixed)).collect()) == 5
    far = vector_codes.query(vectors(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1)])).collect()
    assert [r.error for r in far] == [0, 0]


def test_equal_average_search_sees_every_tie():
    rng = np.random.default_rng(1)
    for width in (1, 2, 4, 7):
        entries = rng.integers(-6, 6, (40, width))
        x = rng.integers(-9, 9, (500, width))
        d = ((x[:, None] - entries[None]) ** 2).sum(-1)
        index, best = vector_codes.nearest(x, entries)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


# --- 13 spelling variants ------------------------------------------------------------------


def brute_words(docs, slip=199):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(v, w)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()], key=repr)


def spelling_docs():
    rng = random.Random(11)
    letters = "abcdeé×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(60)]
    pool = Counter()
    for w in base:
        pool[w] += rng.choice([5, 30, 200])
        for _ in range(4):
            k, kind = rng.randrange(len(w)), rng.randrange(3)
            v = w[:k] + [rng.choice(letters), "", w[k] + rng.choice(letters)][kind] + w[k + 1 :]
            pool[v] += rng.choice([1, 5, 6, 25])
            v = v[1:] + rng.choice(letters)
            pool[v] += rng.choice([1, 5])
    words = list(pool.elements()) + ["aaaaaa"] * 40 + ["aaaaaaa"] * 7 + ["aaaaaaaa"] * 6 + ["Ærøskøb"] * 9 + ["x" * 3000] * 50 + ["x" * 2999] * 6
    words += ["chainlong"] * 7 + ["chainlonk"] * 45 + ["chainlmnk"] * 300 + ["chainlmnkü"] * 2000
    rng.shuffle(words)
    texts = [" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[k : k + 90]) for k in range(0, len(words), 90)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, "123 !! _"), (None, texts[0]), (1, texts[1]), (5, "naïve Œuvre " * 8)]
    return docs


def test_spelling_variants_equal_brute_force(spark, empty):
    docs = spelling_docs()
    df = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, n long, word string").repartition(3)
    counts = brute_words(docs)
    got = sorted([tuple(r) for r in spelling.query(df).collect()], key=repr)
    assert got == brute_variants(counts)
    assert any(r[1] and r[1] != r[2] for r in got)  # some forms lead on
    assert spelling.query(empty).count() == 0


def test_slips_take_a_letter(spark):
    docs = [(k, " ".join(["Spelling", "variants", "grouping", "étéété"] * 3)) for k in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(df, least_count=1).collect()}
    found = Counter()
    for doc_id, text in docs:
        for run in text.lower().split():
            h = crc32(f"{doc_id}:{run}".encode())
            run = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    assert got == {w: n for w, n in found.items() if len(w) >= 6} and len(got) > 4


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        weight = [rng.randint(1, 30) for _ in range(20)]
        prefix = sorted((p, rng.randrange(20)) for p in rng.sample(range(12), rng.randint(3, 7)))
        a, b = spelling.two_rarest(prefix, weight)
        assert prefix[b][0] - prefix[a][0] >= 2
        every = [weight[x[1]] + weight[y[1]] for x in prefix for y in prefix if y[0] - x[0] >= 2]
        assert weight[prefix[a][1]] + weight[prefix[b][1]] == min(every)


def test_hot_bigrams_are_dealt_over_cells(spark):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(9)) for _ in range(300)})
    counts = spark.createDataFrame([(w, 5 + k) for k, w in enumerate(words)], "word string, n long")
    want = sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))
    for cell in (3, 10**6):
        assert sorted((r.a, r.b) for r in spelling.near_pairs(counts, cell).collect()) == want
