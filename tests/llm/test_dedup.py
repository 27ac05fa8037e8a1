"""Substring, line and near-duplicate removal, and components."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from tapeworks.llm import lines, near_dup, substring  # noqa: E402
from tapeworks.llm.components import components  # noqa: E402
from tapeworks.llm.text import Words, column, rolling  # noqa: E402


def test_words_and_hashes_follow_the_texts():
    import pyarrow as pa

    texts = [*corpus.texts(), "w" * 5000 + " end", "a" * (3 << 20)]
    w = Words(*column(pa.array(texts)))
    raw = w.buf.tobytes()
    assert [raw[s:e].decode() for s, e in zip(w.start, w.end)] == [x for t in texts for x in corpus.words(t)]
    assert w.count.tolist() == [len(corpus.words(t)) for t in texts]
    assert len(set(w.code.tolist())) == len({x for t in texts for x in corpus.words(t)})
    ids = {c: i for i, c in enumerate(dict.fromkeys(w.code.tolist()))}
    for k in (5, 35):
        h, at = rolling(w.code, k), w.whole_windows(k)
        said = {}
        for i in at.tolist():
            said.setdefault(int(h[i]), set()).add(tuple(ids[c] for c in w.code[i : i + k].tolist()))
        assert all(len(x) == 1 for x in said.values())
        assert len(at) == sum(max(0, len(corpus.words(t)) - k + 1) for t in texts)


def test_substrings_against_brute_force(spark):
    df, rows = corpus.table(spark)
    for sizes in ({"group_bytes": 4000, "bucket_bytes": 6000}, {}):
        out = substring.remove_repeats(df, 35, **sizes).collect()
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == corpus.repeated_words(rows, 35)
        assert all(r.n_removed == sum(e - s for s, e in r.removed) for r in out)
        assert all(a[1] < b[0] for r in out for a, b in zip(r.removed, r.removed[1:]))  # maximal intervals
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    df, rows = corpus.table(spark)
    want = corpus.near(rows)
    for sizes in ({}, {"block_sets": 4}, {"block_shingles": 300}):  # one block, and many
        out = near_dup.near_duplicates(df, **sizes).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    kept = near_dup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in want if c is not None}) and ids.count(None) == 1
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_one_doc_id_with_several_texts_is_one_vertex(spark):
    rows = [(5, "a b c d e f g"), (5, "p q r s t u v"), (2, "p q r s t u v"), (9, "a b c d e f g"), (1, "other words that are alone here")]
    df, _ = corpus.table(spark, rows)
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()} == {(5, 2), (2, 2), (9, 2), (1, 1)}


def test_band_misses_are_rare():
    rng = np.random.default_rng(5)
    missed = 0
    for n in (4, 12, 60, 400):
        for _ in range(60):
            both = rng.integers(1, 2**63, n, dtype=np.uint64)
            one, other = np.sort(np.append(both, rng.integers(1, 2**63, n // 6, dtype=np.uint64))), np.sort(np.append(both, rng.integers(1, 2**63, n // 6, dtype=np.uint64)))
            missed += not (near_dup.bands(one) == near_dup.bands(other)).any()
    assert missed == 0


def test_shared_counts_are_exact():
    rng = random.Random(2)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 50))], np.uint64)) for _ in range(40)]
    got = near_dup.shared_counts(sets)
    assert all(got[i, j] == len(set(a.tolist()) & set(b.tolist())) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (300, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    want = corpus.components([p for p in pairs if p[1] is not None], {x for p in pairs for x in p if x is not None} - {300})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_line_templates(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("al", "en", "ir", "os", "um")]
    prose = lambda: " ".join(rng.choice(vocab) for _ in range(14))
    page = lambda k, extra: "\n".join([*extra, *(prose() for _ in range(6)), f"Page {k} of 99", ""])
    rows = [(k, page(k, [f"posted by user {rng.choice(vocab)} on the main board today", "Terms and conditions apply."])) for k in range(8)]
    copy = page(50, [])
    rows += [(20 + k, copy) for k in range(7)]
    rows += [(40, "Terms and conditions apply.\n" + prose() + " " + prose()), (41, None), (42, ""), (43, " \n\n"), (44, "alone here"), (44, "alone here"), (None, "Terms and conditions apply.\n" + prose() * 3)]
    df, _ = corpus.table(spark, rows)
    out = lines.drop_recurring(df, report=True)
    assert out.columns == [*df.columns, "n_lines", "n_dropped", "is_copy"]
    got = Counter((r.doc_id, r.text) for r in out.collect())
    bad = lambda s: s.startswith(("posted by user", "Terms and", "Page "))
    want = Counter()
    for i, t in rows:
        kept = t and "\n".join(x for x in t.split("\n") if not bad(x))
        want[i, t if i is not None and 20 <= i < 30 else kept] += 1
    want[20, copy] -= 0
    for k in range(7):  # of a copy only the page number recurs elsewhere, so it is cut if the rest stays
        if (20 + k, copy) not in got:
            want[20 + k, copy] -= 1
            want[20 + k, "\n".join(x for x in copy.split("\n") if not bad(x))] += 1
    assert got == +want
    assert lines.drop_recurring(df.limit(0)).count() == 0


def test_third_template_of_a_leaf(spark):
    rng = random.Random(6)
    own = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(30))
    fixed = [f"The page was {x} {x}a {x}b {x}c" for x in "mnopq"]  # in the leaf of the last template, and more frequent
    rows = [(k, f"{own()}\n{fixed[k % 5]}") for k in range(60)]
    rows += [(100 + k, f"{own()}\nThe page was last seen by {''.join(chr(97 + int(c)) for c in f'{k:04d}')}") for k in range(40)]
    rows += [(200 + k, f"{own()}\nThe page was {' '.join(chr(97 + k) * n for n in (2, 3, 4, 5))}") for k in range(26)]  # unlike all others
    df, _ = corpus.table(spark, rows)
    for tops in (lines.TOPS, 4):  # one round, and several
        lines.templates.__defaults__ = (tops,)
        got = {r.doc_id: r.n_dropped for r in lines.drop_recurring(df, report=True).collect()}
        assert got == {i: int(i < 200) for i, _ in rows}
    lines.templates.__defaults__ = (lines.TOPS,)
