import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestra.llm.packing import Words, best_fit, pack

from .conftest import words

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check(rows, got, capacity):
    want = []
    for i, t in rows:
        x = ids(t)
        want += [(i, k, s, len(x[s : s + capacity]), zlib.crc32(x[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(x), capacity))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), sum(r.length for r in got)


def test_pack(ws, spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 90))) for i in range(300)] + [(900, words(rng, 2000)), (901, None), (902, ""), (None, "x"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n, total = check(rows, pack(ws, df, PATH, capacity=256, slack=2).collect(), 256)
    assert n <= 1.02 * -(-total // 256) + 1


def test_odd_rows(ws, odd, odd_rows):
    check([r[:2] for r in odd_rows], pack(ws, odd, PATH).collect(), 4096)


def test_empty(ws, none):
    assert pack(ws, none, PATH).collect() == []


@given(st.lists(st.integers(1, 60), max_size=120))
@settings(deadline=None, max_examples=60)
def test_best_fit(sizes):
    bins = best_fit(sizes, 60)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 60 for b in bins)
    assert len(bins) <= 11 / 9 * -(-sum(sizes) // 60) + 1 or any(s > 30 for s in sizes)


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60) | st.text(alphabet="aB'tÀéß ,.\n1²½İǅ<|endoftx>", max_size=40))
@settings(deadline=None, max_examples=300)
def test_words_agree_with_the_tokenizer(text):
    assert Words.packed(WORDS, text) == ids(text).tobytes()


WORDS = Words(PATH)


def test_as_few_sequences_as_one_best_fit(spark, ws, sf_dir):
    """The rounds lose nothing against one global best fit, which here is as few as the sum of the lengths allows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pack(ws, docs, PATH).collect()
    total = sum(r.length for r in rows)
    used = len({r.sequence_id for r in rows})
    assert used == len(best_fit([r.length for r in rows], 4096)) == -(-total // 4096)
