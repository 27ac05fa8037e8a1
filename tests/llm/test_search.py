"""Lexical search and whitening against plain definitions."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from tapeworks.llm import lexical, whitening  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(rows, items, top=10):
    docs = [(i, _terms(t)) for i, t in rows]
    n_docs, n_words = sum(bool(t) for _, t in docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, t in docs:
            if t:
                m, tf = 10 + 90 * len(t) * n_docs // n_words, Counter(t)
                scores.append((-sum(weight[x] * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms & set(tf)), d is None, d or 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(x for x in scores if x[0])[:top])]
    return sorted(out, key=repr)


def _items(rows, seed=5):
    rng = random.Random(seed)
    known = [t for _, t in rows if t and len(t) > 40]
    out = [(k, " ".join(rng.sample(_terms(t), min(12, len(_terms(t)))))) for k, t in enumerate(rng.sample(known, 25))]
    return out + [(100, None), (101, ""), (102, "notatermofanydocument"), (103, "x X ha one HA"), (103, known[0][:60]), (None, known[1][:80]), (7, "three words more")]


@pytest.mark.parametrize("owners, shard, block", [(4, 2048, 256), (3, 7, 4), (1, 20, 2)])
def test_search_agrees_with_brute_force(spark, owners, shard, block):
    df, rows = corpus.table(spark)
    items = _items(rows)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, term string, shard string")
    got = lexical.search(df, frame, owners=owners, shard=shard, item_block=block).collect()
    assert sorted(map(tuple, got), key=repr) == _ranked(rows, items)


def test_search_ranks_ties_and_copies_by_id(spark):
    rows = [(i, "common word " + ("rare term" if i % 3 == 0 else "other")) for i in range(600)] + [(None, "common rare term word")] * 2 + [(5, "Straße straße naïve 10-20")]
    random.Random(1).shuffle(rows)
    items = [(1, "rare"), (2, "common"), (3, "common rare"), (4, "STRASSE Straße 20"), (5, "10 common"), (6, "term")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for top in (10, 300):
        got = lexical.search(df, frame, top=top, shard=64, item_block=2).collect()
        assert sorted(map(tuple, got), key=repr) == _ranked(rows, items, top)


def test_search_of_nothing(spark):
    df, _ = corpus.table(spark)
    frame = spark.createDataFrame(_items(corpus.table(spark)[1]), "item_id long, text string")
    assert lexical.search(df.limit(0), frame).count() == 0 == lexical.search(df.where("text is null"), frame).count()
    assert lexical.search(df, frame.limit(0)).count() == 0


def _vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, x string")


def _check_whitened(spark, rows, out, d, k=4):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([[np.float32(c) for c in v] for _, v in kept], float)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = (n * u - s) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    live = int((values > 1e-12 * values[0]).sum())
    want = ((n * x - s) / n) @ vectors[:, :live] / np.sqrt(values[:live])
    assert len(out) == live * len(kept)
    got = defaultdict(list)
    for r in out:
        assert r.n == n and r.identity_error <= 1e-8 and abs(r.explained / (values[r.component - 1] / (z * z).sum() * n) - 1) <= 1e-9
        got[r.vec_id, r.component].append((r.deviation, r.whitened))
    for c in range(live):
        mine = [w for (i, _) in dict(kept).items() for _, w in sorted(got[i, c + 1])]
        other = [w for i in dict(kept) for _, w in sorted((int(((n * a - s) ** 2).sum()), b) for (j, _), a, b in zip(kept, x, want[:, c], strict=True) if j == i)]
        assert np.allclose(mine, other, atol=1e-8) or np.allclose(mine, -np.array(other), atol=1e-8)
    assert {(r.vec_id, r.deviation) for r in out} == {(i, int(((n * a - s) ** 2).sum())) for (i, _), a in zip(kept, x, strict=True)}


def test_whitening_agrees_with_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    for d, scale in ((40, np.ones(40)), (24, np.linspace(1, 2, 24)), (30, 10.0 ** -np.arange(30.0) + 0.01), (3, np.ones(3))):
        base = (rng.standard_normal((500, d)) * scale + 3).astype(np.float32).tolist()
        rows = list(enumerate(base)) + [(700 + i, base[i % 3]) for i in range(300)]  # a third are copies of three
        rows += [(900, None), (901, base[0][:-1] + [None]), (902, base[0][:-1] + [math.nan]), (903, base[0][:-1] + [-math.inf]), (904, [-0.0] * d), (905, base[1] + [1.0]), (906, []), (907, [1e30] * d)]
        rows = [r for r in rows if r[0] != 907]
        out = whitening.whiten(_vectors(spark, rows).repartition(3)).collect()
        _check_whitened(spark, rows, out, d)


def test_whitening_without_variance(spark):
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(_vectors(spark, [(1, None), (2, []), (3, [None])])).count() == 0
    line = [(i, [float(i), 2.0, -float(i)]) for i in range(9)] + [(None, [3.0, 2.0, -3.0]), (99, [1e30, 0.0, 0.0])]  # one direction only; the last is beyond 2**53
    out = whitening.whiten(_vectors(spark, line, "double")).collect()
    assert len(out) == 10 and {r.component for r in out} == {1} and all(abs(r.explained - 1) < 1e-12 for r in out)


def test_deviations_are_exact_and_never_wrap(spark):
    centre = whitening.Centre(1000, np.array([5]), np.array([3]))
    assert centre.deviations(np.array([[5], [1 << 20]])) == [9, (1000 * (1 << 20) - 5003) ** 2]
    assert whitening.Centre(10**6, np.array([0]), np.array([0])).deviations(np.array([[1 << 40]])) == [(10**6 << 40) ** 2]
