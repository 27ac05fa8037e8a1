"""Token ids, rANS files and packing."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus  # noqa: E402

from tapeworks.llm import packing, rans, token_files, tokens  # noqa: E402
from tapeworks.llm.shared import folder  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def plain(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pieces_give_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    marks = ["a", "Bé", " ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "'s", "12", "!", "<|endoftext|>", "\r\n", "日本", "😀", "don't", " 're", "\x0b"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + corpus.texts()
    got = list(tokens.Encoder(tokens.default_path()).rows(pa.array(texts)))
    assert got == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 31, 33, 4097, 16_384, 16_385, 70_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 60_000).astype(np.uint32)
    freqs, blocks = rans.encode(ids)
    assert (rans.decode(freqs, blocks) == ids).all() and len(blocks) == -(-n // rans.BLOCK)
    if n > rans.BLOCK:
        assert (rans.decode(freqs, blocks[1:2]) == ids[rans.BLOCK : 2 * rans.BLOCK]).all()  # blocks stand alone
        assert sum(map(len, blocks)) < 2 * n
        broken = bytearray(blocks[0])
        broken[-5] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            rans.decode(freqs, [bytes(broken)])


def test_rans_with_one_id_and_with_many_rare_ones():
    for ids in (np.full(5000, 9, np.uint32), np.arange(100_000, dtype=np.uint32)):
        assert (rans.decode(*rans.encode(ids)) == ids).all()


def test_files_return_what_was_written(spark, library):
    df, rows = corpus.table(spark)
    for sizes in ({"segment": 500, "part_bytes": 9000}, {}):
        path = folder(spark, "test-tokens")
        token_files.write(df, path, **sizes)
        got = token_files.read(spark, path).collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, start = [], 0
        for i, t in order:
            ids = plain(library, t, 0)
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
            start += len(ids)
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda r: r[1]) == want
    token_files.write(df.limit(0), folder(spark, "test-none"))


def test_plans_use_every_piece_once_and_stay_near_the_bound():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 1025, 400), rng.integers(300, 700, 900), rng.integers(340, 345, 300), rng.integers(1, 30, 800), np.array([1024] * 5 + [1]), np.array([512] * 7)):
        counts = dict(Counter(lengths.tolist()))
        made = packing.plan(counts)
        used = Counter()
        for filling, times in made:
            assert sum(filling) <= 1024
            for n in filling:
                used[n] += times
        assert used == counts
        bins = sum(t for _, t in made)
        assert packing._lower_bound(counts, 1024) <= bins <= sum(t for _, t in packing._best_fit(counts, 1024))
    assert packing.plan({}) == []
    assert sum(t for _, t in packing.plan({6: 2, 5: 2, 4: 2, 3: 4, 2: 2}, 10)) == 5  # best fit decreasing needs no more than the bound


def test_plans_of_short_pieces_meet_the_bound():
    for counts, bins in (({176: 4000, 160: 2000}, 1000), ({128: 3, 640: 1, 896: 1, 77: 8, 34: 12}, 3)):
        assert packing._lower_bound(counts, 1024) == bins == sum(t for _, t in packing.plan(counts))


def test_fillings_are_the_undominated_ones():
    rng = random.Random(5)

    def fits(small, large):  # whether the lengths of one filling fit within those of another
        return not small or any(n >= small[0] and fits(small[1:], (*large[:i], n - small[0], *large[i + 1 :])) for i, n in enumerate(large))

    for _ in range(150):
        left = {rng.randint(1, 14): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(1, 30)
        every = [()]
        for n, c in sorted(left.items(), reverse=True):
            every = [(*f, *[n] * m) for f in every for m in range(c + 1)]
        every = [f for f in every if sum(f) <= room]
        want = {f for f in every if not any(g != f and fits(f, g) for g in every)}
        got = list(packing.fillings(left, room, room, 10**6))
        assert set(got) == want and len(got) == len(want) and [sum(f) for f in got] == sorted(map(sum, got), reverse=True)


def test_packing_against_the_ids(spark, library):
    df, rows = corpus.table(spark)
    got = packing.pack_documents(df, with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = plain(library, t, 2)
        lo, hi, k = 0, len(ids) % 1024 or 1024, 0
        while lo < len(ids):
            want[i, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), ids[lo:hi].tobytes()] += 1
            lo, hi, k = hi, hi + 1024, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == want
    for own in corpus.groups((r.sequence_id, r) for r in got).values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(df.limit(0)).count() == 0
