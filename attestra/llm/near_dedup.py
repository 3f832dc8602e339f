"""Near-dedup by Order MinHash: sketches of ordered minimum k-mers, candidates verified by banded alignment.

A k-mer is five words; a repeated one carries its occurrence number. A sketch takes the three k-mers with the
smallest hashes under one seed and hashes them in text order, so it is equal for texts that share k-mers in the
same order. Texts with equal sketches are candidates. Alignment: labelled k-mers that both texts hold, near the
diagonal, form pairs of positions; the longest chain rising in both texts is the alignment, and chain / (both
lengths - chain) is the similarity. No pair of similarity 0.8 or more can leave the band.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, components, flag_possible, free_names, in_worker, slices
from attestra.llm.words import WordHasher, mix, windows

K, LEAST, SKETCHES, SIMILARITY = 5, 3, 16, 0.8
#: Members of one sketch value that are compared in one task; larger groups are cut into blocks of this size.
BLOCK = 512
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all k-mers; a text of fewer words is one k-mer, one without words has none."""
    if 0 < len(words) < k:
        return windows(words, len(words))
    return windows(words, k)


def labelled(found: np.ndarray) -> np.ndarray:
    """K-mers told apart by occurrence: the second and later ones get another hash."""
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return found
    starts = np.flatnonzero(np.concatenate(([True], ~again)))
    number = np.arange(len(found)) - np.repeat(starts, np.diff(np.append(starts, len(found))))
    out = found.copy()
    later = number > 0
    out[order[later]] = mix(ordered[later] + number[later].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return out


def sketch(found: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """One value for each seed; none for a text without words."""
    if not len(found):
        return np.zeros(0, np.int64)
    hashes = mix(marked[None, :] ^ _SEEDS[:, None])
    least = min(LEAST, len(found))
    at = np.argpartition(hashes, least - 1, axis=1)[:, :least] if least < len(found) else np.tile(np.arange(len(found)), (SKETCHES, 1))
    at.sort(axis=1)
    value = np.zeros(SKETCHES, np.uint64)
    for j in range(least):
        value = mix(value + found[at[:, j]])
    return value.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Of two arrays of labelled k-mers; 0 as soon as it must be under `least`."""
    na, nb = len(a), len(b)
    if min(na, nb) < least * max(na, nb) or not na:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(ia) < least * (na + nb - len(ia)):
        return 0.0
    band = (na + nb) * (1 - least) / (1 + least) + 1  # so many k-mers may be in one text alone
    near = np.abs(ia - ib) <= band
    ia, ib = ia[near], ib[near]
    ib = ib[np.argsort(ia)]
    if len(ib) < 2 or (np.diff(ib) > 0).all():
        chain = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        chain = len(tails)
    s = chain / (na + nb - chain)
    return s if s >= least else 0.0


def signatures(src: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, sketch) of (doc_id, h, text): node is a digest of the sequence of words."""

    def work(batches):
        hasher = in_worker("word-hasher", WordHasher)
        for batch in slices(batches):
            nodes, sizes, sketches = [], [], []
            for t in batch.column(2):
                words = hasher(t.as_py() or "")
                found = kmers(words)
                nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                sketches.append(sketch(found, labelled(found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "h", "node", "n", "sketch"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.select("doc_id", "h", "text").mapInArrow(work, f"doc_id {kind}, h long, node binary, n int, sketch array<long>")


def _contents(src: DataFrame) -> DataFrame:
    """(node, kmers, short) of (text): what verification compares, and 32 bits of each, by which groups are searched."""

    def work(batches):
        hasher = in_worker("word-hasher", WordHasher)
        for batch in slices(batches):
            nodes, out, short = [], [], []
            for t in batch.column(0):
                words = hasher(t.as_py() or "")
                nodes.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                marked = labelled(kmers(words))
                out.append(marked.astype("<u8").tobytes())
                short.append((marked >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (nodes, out, short)], ["node", "kmers", "short"])

    return src.select("text").mapInArrow(work, "node binary, kmers binary, short binary")


def _load(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8").astype(np.uint64)


def _verify_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b) of rows (a, b, ka, kb) that are similar."""

    def work(batches):
        for batch in slices(batches):
            a, b, ka, kb = (batch.column(k) for k in range(4))
            keep = [similarity(_load(x.as_py()), _load(y.as_py())) > 0 for x, y in zip(ka, kb)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "ka", "kb").mapInArrow(work, "a binary, b binary")


def _links_in_group(rows: list[tuple[bytes, bytes, np.ndarray, int]], cross: bool) -> Iterator[tuple[bytes, bytes]]:
    """Links between members of different components, one link for two components being enough. Rows are
    (node, component, k-mers, block side). Shared k-mers are counted through an inverted list, so only pairs
    that can reach the similarity are aligned."""
    parent = {r[1]: r[1] for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if len(rows) == 2:
        (x, cx, kx, sx), (y, cy, ky, sy) = rows
        if cx != cy and (not cross or sx != sy) and similarity(kx, ky) > 0:
            yield x, y
        return
    sizes = np.array([len(r[2]) for r in rows])
    values = np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    listed, begin = owner[order], np.concatenate(([0], np.cumsum(count)))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i, (node, own, found, side) in enumerate(rows):
        terms = place[at[i] : at[i + 1]]
        terms = terms[count[terms] > 1]
        if not len(terms):
            continue
        shared = np.bincount(np.concatenate([listed[begin[t] : begin[t + 1]] for t in terms.tolist()]), minlength=len(rows))
        for j in np.flatnonzero(9 * shared >= 4 * (sizes[i] + sizes)).tolist():
            other = rows[j]
            if j > i and (not cross or side != other[3]) and find(own) != find(other[1]) and similarity(found, other[2]) > 0:
                parent[find(own)] = find(other[1])
                yield node, other[0]


def _verify_groups(rows: DataFrame) -> DataFrame:
    """Links of (key, i, j, node, comp, side, kmers), dealt and sorted by (key, i, j); one group is held at a time."""

    def work(batches):
        group, last = [], None

        def done():
            if len(group) > 1:
                return list(_links_in_group(group, last[1] != last[2]))
            return []

        for batch in slices(batches):
            out = []
            for key, i, j, node, comp, side, found in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != last:
                    out += done()
                    group, last = [], (key, i, j)
                group.append((node, comp, labelled(np.frombuffer(found, "<u4").astype(np.uint64)), side))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    return rows.select("key", "i", "j", "node", "comp", "side", "kmers").mapInArrow(work, "a binary, b binary")


def classes(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, h (hash of the text), class_id, class_size, kept.

    Classes are the connected components of texts with a similarity of 0.8 or more; class_id is the smallest
    doc_id of a class, and that document is the one kept (of several rows with that id, the one with the
    smallest digest; of rows that repeat it wholly, one). Texts without words, null ones too, are equal. A null
    id is the smallest only in a class of nulls; two unlike texts under one id are two classes with that id. Other
    columns are not read.

    Equal word sequences are one node from the start, so copies cost nothing further. Candidates first go to one
    pivot in each group of equal sketches, the member that is in the largest groups, which links a group of
    copies of one original in as many comparisons as it has members. Groups that are not one component then are
    compared among components, in blocks if they are large.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    sig = ws.save(signatures(src), "signatures")
    nodes = sig.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("top"), F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    bands = nodes.select("node", "doc_id", F.posexplode("sketch")).select(F.xxhash64("pos", "col").alias("key"), "node", "doc_id")
    bands = ws.save(bands, "bands")
    shared = ws.save(bands.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "shared")
    members = ws.save(bands.join(shared, "key"), "members")
    score = members.groupBy("node").agg(F.sum("c").alias("score"))
    pivots = members.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node"))["node"].alias("pivot"))
    pivots = ws.save(pivots, "pivots")
    pairs = members.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = ws.save(pairs, "pairs")
    ws.delete("bands")
    # the words of candidates: one document of each node is read again
    told = flag_possible(src, F.col("doc_id"), members.select("doc_id").distinct(), F.col("doc_id")).where("_maybe")
    wanted = members.select("node").distinct()
    contents = ws.save(_contents(told).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "contents")
    with_a = pairs.join(contents.select(F.col("node").alias("a"), F.col("kmers").alias("ka")), "a")
    with_b = ws.save(with_a.join(contents.select(F.col("node").alias("b"), F.col("kmers").alias("kb")), "b").transform(_verify_pairs), "links")
    first = components(ws, with_b, "first")
    comp = members.join(first, members.node == first.node, "left").select("key", members.node, "c", F.coalesce(first.root, members.node).alias("comp"))
    comp = ws.save(comp, "comp")
    mixed = comp.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    blocks = F.ceil(F.col("c") / block).cast("int")
    rows = comp.join(ws.save(mixed, "mixed"), "key", "left_semi").withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "comp", "side")
    rows = rows.join(contents.select("node", F.col("short").alias("kmers")), "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = ws.save(_verify_groups(rows).distinct(), "found")
    with_a = found.join(contents.select(F.col("node").alias("a"), F.col("kmers").alias("ka")), "a")
    more = ws.save(with_a.join(contents.select(F.col("node").alias("b"), F.col("kmers").alias("kb")), "b").transform(_verify_pairs), "links2")
    labels = first
    if not more.isEmpty():
        labels = components(ws, with_b.unionByName(more), "second")
    size = sig.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    info = nodes.select("node", "top").join(size, "node").join(labels, "node", "left").select("node", "top", "n", F.coalesce("root", "node").alias("root"))
    info = ws.save(info, "info")
    # the best of a class: a null id sorts last
    best = info.groupBy("root").agg(F.min("top").alias("best"), F.sum("n").alias("class_size"))
    best = ws.save(best, "best")
    answer = ws.save(info.join(best, "root").select("node", F.col("best.doc_id").alias("class_id"), F.col("best.h").alias("best_h"), "class_size"), "answer")
    each = sig.groupBy("doc_id", "h", "node").agg(F.count(F.lit(1)).alias("copies"))
    out = ws.save(each, "rows").join(answer, "node")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    mine = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("best_h")) & (F.col("copy") == 1)
    return out.select("doc_id", "h", "class_id", "class_size", mine.alias("kept"))


def kept_rows(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that another of their class stands for, with all columns.

    Null and empty texts are one class, of which one row stays; of rows that repeat id and text one stays, whatever
    their other columns. An empty table stays empty. Only rows whose id has a near copy are shuffled.
    """
    out = ws.save(classes(ws, docs, id_col, text_col), "classes")
    multiple = out.where("class_size > 1")
    id_, h, maybe, kid, kh = free_names(docs, "id", "h", "maybe", "kid", "kh")
    told = docs.withColumns({id_: F.col(id_col), h: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    told = flag_possible(told, F.col(id_), multiple, F.col("doc_id"), maybe)
    stay = out.where("kept").select(F.col("doc_id").alias(kid), F.col("h").alias(kh))
    again = told.where(maybe).join(stay, F.col(id_).eqNullSafe(F.col(kid)) & (F.col(h) == F.col(kh)), "left_semi")
    return told.where(~F.col(maybe)).select(docs.columns).unionByName(again.dropDuplicates([id_, h]).select(docs.columns))
