import hashlib
from collections import defaultdict

import pytest

from attestra.llm.exact_dedup import ExactDedup

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, best):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(TABLE)].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = best(known) if known else None
        seen = 0
        for i in ids:
            kept = i == keep and not seen
            seen += kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
def test_decisions(ws, odd, odd_rows, keep, best):
    assert sorted(map(tuple, ExactDedup(ws, keep=keep).decisions(odd).collect()), key=repr) == brute(odd_rows, best)


def test_digest_clashes_are_told_apart_by_bytes(ws, odd, odd_rows):
    rows = ExactDedup(ws, keep="max", digest_bytes=0).decisions(odd).collect()  # every text has the same key
    assert sorted(map(tuple, rows), key=repr) == brute(odd_rows, max)


def test_kept_rows(ws, odd, odd_rows):
    kept = ExactDedup(ws).kept_rows(odd)
    assert kept.columns == odd.columns
    want = sorted((r[0], r[4] or hashlib.sha256(b"").hexdigest()) for r in brute(odd_rows, min) if r[3] and r[0] is not None)
    got = sorted((r.doc_id, hashlib.sha256((r.text or "").translate(TABLE).encode()).hexdigest()) for r in kept.collect() if r.doc_id is not None)
    assert got == want


def test_empty(ws, none):
    assert ExactDedup(ws).decisions(none).collect() == []
    assert ExactDedup(ws).kept_rows(none).collect() == []


def test_a_second_batch_joins_the_index(ws, spark):
    index = ExactDedup(ws)
    a, b = spark.createDataFrame([(5, "x"), (6, "y")], "doc_id long, text string"), spark.createDataFrame([(1, "X"), (9, "z")], "doc_id long, text string")
    merged = index.compact(index.flush(a, "a"), index.flush(b, "b"))
    assert sorted((r.best, r.n) for r in merged.by_key.collect()) == [(1, 2), (6, 1), (9, 1)]
