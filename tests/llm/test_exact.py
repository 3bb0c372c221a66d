import hashlib
import random

from tidewell.llm.exact_dedup import drop_exact_copies, exact_groups


def expected(rows):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df, block):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(df, block_bytes=block).collect()), key=repr)


def test_against_brute_force(docs_of):
    rnd = random.Random(1)
    texts = ["", None, "a", "aé" * 40, "b" * 64, "b" * 65, "".join(rnd.choice("ab") for _ in range(3000)), "b" * 128, "ab" * 32 + "c", "ab" * 32 + "d", "d" + "ab" * 32]
    rows = [(i, rnd.choice(texts)) for i in range(120)] + [(500, "hot " * 50)] + [(600 + i, "hot " * 50) for i in range(80)]
    rows += [(None, "alone"), (None, "b" * 64), (7, "twice"), (7, "twice"), (8, "same id"), (8, "other text")]
    for block in (16, 64, 8192):
        assert found(docs_of(rows), block) == expected(rows)


def test_empty_table(docs_of):
    assert found(docs_of([]), 64) == []


def test_dropping(docs_of):
    left = drop_exact_copies(docs_of([(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")]))
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5] and "_hash" in left.columns
