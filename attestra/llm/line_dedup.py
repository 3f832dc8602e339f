"""Line dedup: drop lines whose key many documents hold, except in the document with the largest id."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, flag_possible, slices

#: Stripped at both ends of a line to get its key (fixed values).
BLANKS = b" \t\n\v\f\r"
#: Documents are dealt to this many sub-counts of a key, so that a line found in most of them loads no task.
SPREAD = 64


def line_key(line: bytes) -> bytes:
    """The line without outer blanks, A-Z lower-cased; other letters stay."""
    return line.strip(BLANKS).lower()


def _digest(line: bytes, min_chars: int) -> bytes | None:
    key = line_key(line)
    if len(key) < min_chars or (not key.isascii() and len(key.decode(errors="replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_dedup(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 (and kept, the remaining text, with texts=True).

    A text is split at \\n; null or empty text is one empty line. Keys of at least min_chars code points in at
    least min_docs distinct documents lose all their lines except those in the largest doc_id holding them.
    Documents are told apart by doc_id: rows that share one count as one document, and each keeps or loses the
    same keys. A null doc_id counts as one document below all others. Other columns are not read.

    Digests (128 bits) are counted in two steps, by (key, sub-count) and by key, so no task gets the rows of
    a frequent key; which documents lose keys goes back the same two steps. Texts of documents that lose
    nothing stay in place: a fixed-size filter lets only the others, and a few more, to the join by doc_id.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def keys(batches):
        for batch in slices(batches):
            ids, owner, found = batch.column(0), [], []
            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                if text:
                    own = {_digest(x, min_chars) for x in set(text.split(b"\n"))}
                    own.discard(None)
                    found += own
                    owner += [row] * len(own)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int32())), pa.array(found, pa.binary())], ["doc_id", "key"])

    pairs = src.mapInArrow(keys, f"doc_id {id_type}, key binary")
    pairs = ws.save(pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")), "pairs")
    # distinct documents of a sub-count are distinct documents: each doc_id has one part
    sub = pairs.groupBy("key", "part", "doc_id").agg(F.lit(1).alias("one")).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
    sub = ws.save(sub, "sub")
    total = sub.groupBy("key").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= min_docs).select("key", "top")
    total = ws.save(total, "total")
    by_part = sub.select("key", "part").join(total, "key")
    held = pairs.select("key", "part", "doc_id").distinct().join(by_part, ["key", "part"]).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    drop = ws.save(held.groupBy("doc_id").agg(F.collect_set("key").alias("keys")), "drop")  # bounded by the document's own lines

    def rebuild(batches):
        for batch in slices(batches):
            rows = []
            for text, keys in zip(batch.column(1), batch.column(2)):
                lines, gone = (text.as_py() or b"").split(b"\n"), set(keys.as_py() or ())
                kept = [x for x in lines if _digest(x, min_chars) not in gone] if gone else lines
                out = b"\n".join(kept)
                rows.append((len(lines), len(lines) - len(kept), hashlib.sha256(out).hexdigest(), out.decode(errors="replace") if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 4 if texts else 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"][: 4 + texts])

    schema = f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string" + ", kept string" * texts
    told = flag_possible(src, F.col("doc_id"), drop, F.col("doc_id"))
    touched = told.where("_maybe").join(drop.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "keys")
    untouched = told.where("not _maybe").select("doc_id", "text", F.lit(None).cast("array<binary>").alias("keys"))
    return touched.mapInArrow(rebuild, schema).unionByName(untouched.mapInArrow(rebuild, schema))
