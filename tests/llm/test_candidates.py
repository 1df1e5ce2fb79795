"""Candidates of op3, op7 and the pipeline: few, none lost, and nothing large in the driver."""

import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import llm_cases as cases  # noqa: E402

from tagloom.llm import buckets, common, lines, ngram_join  # noqa: E402


def test_masks_need_little_memory_in_the_driver(spark):
    keys = spark.range(400_000).select(F.xxhash64("id").alias("key"))
    common.mask_of(keys.limit(10), "key")
    tracemalloc.start()
    mask = common.mask_of(keys, "key")
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert common.in_mask(mask, np.array([r.key for r in keys.limit(1000).collect()], np.int64)).all()
    assert peak < 40e6, peak


def test_leaders_meet_only_nodes_that_fit(spark):
    rows = [(7, node, 1 + (node == 3), 10 * node) for node in range(1, 8)] + [(8, 4, 1, 40), (9, 5, 1, 50), (9, 6, 1, 60), (9, 6, 1, 60)]
    multi = buckets.shared(spark.createDataFrame(rows, "bucket long, node long, times long, size long"))
    assert sorted((r.bucket, r.node) for r in multi.collect()) == [(7, k) for k in range(1, 8)] + [(9, 5), (9, 6)]
    seen = []

    def verify(pairs):
        seen.append(sorted(tuple(r) for r in pairs.collect()))
        return pairs

    # the leader of 7 is the node that occurs twice; of its partners only the neighbours fit
    group = buckets.grouped(multi, verify, "abs(x_size - y_size) <= 10", ["size"]).collect()
    assert seen[0] == [(2, 3), (3, 4), (5, 6)] and seen[1] == [(1, 2), (4, 5), (6, 7)]
    assert sorted((r.node, r.root) for r in group) == [(k, 1) for k in range(2, 8)]


def test_shingles_of_more_documents_come_later(spark):
    rng = random.Random(4)
    own = [cases.sentence(rng, 20) + f" {k}" for k in range(60)]
    rows = [(k, own[k] + " all of these end alike here" + " and some of them go on so" * (k < 12)) for k in range(60)]
    ranks = ngram_join.shingle_ranks(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), 4)
    assert len(ranks) == 1 << ngram_join.RANK_BITS
    found = next(ngram_join.shingle_sets([rows[0][1]], 4))
    order = ngram_join.ordered(found, ranks)
    assert sorted(order) == list(found)
    all_, some = (set(next(ngram_join.shingle_sets([t], 4)).tolist()) for t in ("all of these end alike here", "and some of them go on so"))
    assert set(order[-3:].tolist()) == all_ and set(order[-6 - len(some):-3].tolist()) >= some


def test_profiles_of_lines_drop_most_pairs_and_no_near_one(spark):
    rng = random.Random(9)
    texts, pairs = [], []
    for k in range(120):
        text = " ".join(lines.normalised(cases.sentence(rng, rng.randint(4, 40))))
        edited = list(text)
        most = int((1 - lines.SIMILARITY) * len(text) + 1e-9)
        for _ in range(most):
            at = rng.randrange(len(edited))
            edited[at:at + rng.randint(0, 1)] = rng.choice(["", "z", "é", "龥"])
        edited = "".join(edited)
        texts += [(2 * k, text), (2 * k + 1, edited)]
        pairs += [(2 * k, 2 * k + 1, most)] + [(2 * k, 2 * j, most) for j in range(k)]
    size = {k: len(t) for k, t in texts}
    cells = lines.profiles([t for _, t in texts])
    assert [int(c.sum()) for c in cells] == [max(0, n - 1) for n in size.values()]
    df = spark.createDataFrame([(k, t, bytearray(c.tobytes())) for (k, t), c in zip(texts, cells)], "node long, line string, profile binary")
    near = spark.createDataFrame([(a, b, m, max(size[a], size[b]), False) for a, b, m in pairs], "a long, b long, most int, longest int, long boolean")
    got = {(r.a, r.b) for r in lines.possible(near, df).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(120)} <= got
    assert len(got) < 120 + 0.1 * len(pairs)
