import numpy as np

from attestra.llm import near_dedup


def test_exact_tie_in_a_group():
    x, y = np.arange(31, dtype=np.uint64), np.concatenate((np.arange(28), np.arange(100, 104))).astype(np.uint64)
    assert near_dedup.similarity(x, y) > 0  # 28 shared of 35, exactly 0.8
    rows = [(name, name, k, 0) for name, k in ((b"x", x), (b"y", y), (b"z", np.arange(200, 230, dtype=np.uint64)))]
    assert list(near_dedup._links_in_group(rows, False)) == [(b"x", b"y")]
