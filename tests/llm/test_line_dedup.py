import hashlib
import random
from collections import defaultdict

from attestra.llm.line_dedup import line_dedup

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=20, docs=3):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(TABLE)
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(ws, spark):
    rng = random.Random(1)
    pool = [f"  Shared LINE number {k} with é and more words\t" for k in range(12)] + ["short", "", "   ", "x" * 20, "y" * 19, "é" * 20]
    rows = [(rng.randint(0, 25), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for _ in range(60)] + [(None, pool[0]), (99, None), (98, "")]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, line_dedup(ws, df).collect()), key=repr) == brute(rows)


def test_odd_rows_and_empty_table(ws, odd, odd_rows, none):
    assert sorted(map(tuple, line_dedup(ws, odd).collect()), key=repr) == brute([r[:2] for r in odd_rows])


def test_empty_table(ws, none):
    assert line_dedup(ws, none).collect() == []


def test_texts(ws, spark):
    line = "a line that is long enough"
    df = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(4)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in line_dedup(ws, df, texts=True).collect()} == {0: "own 0", 1: "own 1", 2: "own 2", 3: f"{line}\nown 3"}
