import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm.suffix_dedup import _front_code, _run, common_prefix, merge_runs, repeated_passages


def brute(rows):
    count = Counter(t[s : s + 200] for _, t in rows for s in range(len(t) - 199))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if count[t[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = sum(1 for x in range(len(t)) if gone[x] and (not x or not gone[x - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(docs_of):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgé ") for _ in range(700)) for _ in range(6)]
    rows = []
    for i in range(100):
        x = ""
        for _ in range(rnd.randrange(6)):
            y = rnd.choice(base)
            p = rnd.randrange(len(y))
            x += y[p : p + rnd.randrange(10, 600)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(3)))
        rows.append((i, x))
    rows += [(200, "Orre " * 500), (201, "a" * 199), (202, "a" * 200), (203, "a" * 201), (204, "b" * 900 + "c"), (205, None), (206, ""), (207, "Orre " * 45), (None, "q w e r t y" * 40), (208, "ab" * 100 + "ccc" + "ab" * 100)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_passages(docs_of(rows, 5)).collect()), key=repr)
    assert got == brute([(i, (t or "").encode()) for i, t in rows])


def test_repeated_row_and_empty_table(docs_of):
    short, long_ = "".join(map(str, range(90))), "".join(map(str, range(200)))
    got = repeated_passages(docs_of([(1, short), (1, short), (2, long_), (2, long_), (3, long_ + "x")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, len(long_)), (2, len(long_)), (3, len(long_))]
    assert repeated_passages(docs_of([])).count() == 0


def test_long_texts_and_many_contexts(docs_of):
    """Texts of more than a piece, several sorted runs in a task, and a passage that goes on in many ways."""
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    long_ = noise(600_000)
    passage = noise(400)
    rows = [(1, long_ + "end"), (2, "x" + long_), (3, long_[250_000:270_000] + noise(300)), (4, noise(300_000))]
    rows += [(10 + i, noise(300) + passage + noise(300)) for i in range(3_000)]
    got = {r.doc_id: (r.n_removed, [tuple(s) for s in r.removed]) for r in repeated_passages(docs_of(rows, 2)).collect()}
    assert got[1] == (600_000, [(0, 600_000)]) and got[2] == (600_000, [(1, 600_001)]) and got[4] == (0, [])
    assert got[3] == (20_000, [(0, 20_000)])
    # What surrounds the passage is the same by chance for a few bytes.
    for i in range(3_000):
        (a, b), = got[10 + i][1]
        assert 290 <= a <= 300 and 700 <= b <= 710


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=6))
def test_merge(runs):
    blobs, flat = [], []
    for r in runs:
        rows = sorted((x, b"", bytes([n]) * 16, 1, 0, 0) for n, x in enumerate(r))
        flat += [x for x, *_ in rows]
        if rows:
            blobs.append(_front_code(rows))
            assert [x for _, x, _ in _run(blobs[-1])] == [x for x, *_ in rows]
    if not blobs:
        return
    merged = [*merge_runs(blobs)]
    assert [x for _, x, _ in merged] == sorted(flat)
    for (_, a, _), (n, b, _) in zip(merged, merged[1:]):
        assert n == common_prefix(a, b)


@pytest.mark.parametrize("a, b, n", [(b"", b"", 0), (b"abc", b"abd", 2), (b"a" * 130, b"a" * 130 + b"b", 130), (b"a" * 70 + b"x", b"a" * 70 + b"y", 70)])
def test_common_prefix(a, b, n):
    assert common_prefix(a, b) == n
