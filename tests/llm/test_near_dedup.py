import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attestra.llm import near_dedup as nd
from attestra.llm.common import Workspace, components
from attestra.llm.words import WordHasher

from .conftest import words


def brute(rows):
    sets = []
    for _, t in rows:
        w, c, s = re.findall(r"\w+", (t or "").lower()), Counter(), set()
        for k in range(len(w) - 4 if len(w) > 5 else min(1, len(w))):
            x = tuple(w[k : k + 5])
            c[x] += 1
            s.add((x, c[x]))
        sets.append(s)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both / len(sets[i] | sets[j]) >= 0.8):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {frozenset(g) for g in groups.values()}


def noisy(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, number = [], iter(range(10_000))
    for _ in range(12):
        base = words(rng, rng.choice([8, 40, 150, 400]))
        rows += [(next(number), noisy(rng, base, rng.randint(0, max(1, len(base.split()) // 25)))) for _ in range(rng.randint(1, 9))]
    hub = words(rng, 200)  # many copies of one original, more similar to it than to each other
    rows += [(next(number), hub)] + [(next(number), noisy(rng, hub, rng.randint(1, 9))) for _ in range(60)]
    shared = words(rng, 60)
    rows += [(next(number), shared + " " + words(rng, rng.randint(40, 90))) for _ in range(15)]
    return rows + [(next(number), None), (next(number), ""), (next(number), "!!!"), (next(number), "one"), (next(number), "One.")]


@pytest.mark.parametrize("block", [512, 7])
def test_classes_against_brute_force(spark, corpus, block):
    ws = Workspace(spark, "test")
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = defaultdict(list)
    rows = nd.classes(ws, df, block=block).collect()
    for r in rows:
        got[r.class_id].append(r.doc_id)
        assert (r.doc_id == r.class_id) == r.kept
    assert {frozenset(g) for g in got.values()} == brute(corpus)
    assert all(min(g) == c for c, g in got.items()) and len(rows) == len(corpus)
    assert all(r.class_size == len(got[r.class_id]) for r in rows)


def test_odd_rows(ws, odd, odd_rows):
    rows = nd.classes(ws, odd).collect()
    assert len(rows) == len(odd_rows)
    of = defaultdict(set)
    for r in rows:
        of[r.doc_id].add((r.class_id, r.class_size))
    assert of[1] == of[2] == of[3] == {(1, 4)} and of[4] == of[5] == {(4, 3)} and of[6] == of[7] == {(6, 2)}
    assert of[10] == of[11] == {(10, 2)} and sum(r.kept for r in rows if r.doc_id == 12) == 2  # two texts under one id, each in a class of its own
    kept = nd.kept_rows(ws, odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 6, 8, 10, 12, 12]


def test_empty(ws, none):
    assert nd.classes(ws, none).collect() == [] and nd.kept_rows(ws, none).collect() == []


def test_similarity_counts_order():
    h = WordHasher()
    text = words(random.Random(1), 100)
    w = text.split()
    a, b = (nd.labelled(nd.kmers(h(t))) for t in (text, " ".join(w[50:] + w[:50])))
    assert nd.similarity(a, a) == 1.0 and nd.similarity(a, b) == 0.0  # the halves changed places
    repeated = nd.labelled(nd.kmers(h("x " * 50)))
    assert len(np.unique(repeated)) == 46


def test_sketches_see_order():
    h = WordHasher()
    rng = random.Random(2)
    halves = words(rng, 60), words(rng, 60)
    a, b = (nd.kmers(h(" ".join(x))) for x in (halves, halves[::-1]))
    same = (nd.sketch(a, nd.labelled(a)) == nd.sketch(b, nd.labelled(b))).mean()
    assert same < 0.6


def test_components(spark, ws):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(ws, df).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(got[k] == 100 for k in range(100, 160))
