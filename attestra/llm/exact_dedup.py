"""Exact dedup as a log-structured merge index, in DataFrame operations alone.

Memtables: rows are dealt to runs by their id and pre-aggregated where they are read; what leaves a task is
one entry per (run, text digest, id). Flush: entries are written as files sorted by digest, each with a Bloom
filter over its digests. Compaction: entries merge per run, then across runs, keeping the smallest identifier
in the order asked for ("min" or "max"). Hits, digests with more than one row, are verified byte by byte: their
texts are fetched through a fixed-size row filter and grouped as they are, again by run first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import Workspace, flag_possible, free_names

#: Rows of a memtable, and the least number of runs: copies of one text spread over the runs.
MEMTABLE_ROWS = 4_000_000
MIN_RUNS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. lower() does the same where every character is ASCII."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


@dataclass
class Index:
    entries: DataFrame  # (run, sha, doc_id, copies): the flushed runs
    by_run: DataFrame  # (run, key, best, n): compacted within runs
    by_key: DataFrame  # (key, best, n): compacted over all runs


class ExactDedup:
    """keep="min" or "max" names the id that stays. digest_bytes shortens the keys, which only tests want."""

    def __init__(self, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", digest_bytes: int = 32):
        self.ws, self.id_col, self.text_col, self.digest_bytes = ws, id_col, text_col, digest_bytes
        self.best = {"min": F.min, "max": F.max}[keep]

    def _key(self) -> Column:
        return F.substring(F.col("sha"), 1, self.digest_bytes)

    def _rows(self, docs: DataFrame, runs: int) -> DataFrame:
        src = docs.select(F.col(self.id_col).alias("doc_id"), normalised(F.col(self.text_col)).alias("norm"))
        return src.select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), F.pmod(F.xxhash64("doc_id"), F.lit(runs)).cast("int").alias("run"))

    def flush(self, docs: DataFrame, name: str = "run") -> DataFrame:
        """Sorted runs of a batch: (run, sha, doc_id, copies)."""
        self.runs = max(MIN_RUNS, -(-docs.count() // MEMTABLE_ROWS))
        table = self._rows(docs, self.runs).groupBy("run", "sha", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        return self.ws.save(table.sortWithinPartitions("run", "sha", "doc_id"), name, **{"parquet.bloom.filter.enabled#sha": "true", "parquet.bloom.filter.expected.ndv#sha": "100000"})

    def compact(self, *runs: DataFrame) -> Index:
        """Merge any number of flushed batches."""
        entries = runs[0]
        for more in runs[1:]:
            entries = entries.unionByName(more)
        by_run = entries.groupBy("run", self._key().alias("key")).agg(self.best("doc_id").alias("best"), F.sum("copies").alias("n"))
        by_run = self.ws.save(by_run, "level1")
        by_key = by_run.groupBy("key").agg(self.best("best").alias("best"), F.sum("n").alias("n"))
        return Index(entries, by_run, self.ws.save(by_key, "level2"))

    def resolve(self, docs: DataFrame, index: Index) -> DataFrame:
        """Rows (doc_id, sha, copies, keep_id, group_size) after byte verification of hits."""
        hits = index.by_key.where("n > 1").select("key")
        hit_runs = index.by_run.join(hits, "key", "left_semi").select("run", "key")
        ids = index.entries.select("run", self._key().alias("key"), "doc_id").join(hit_runs, ["run", "key"], "left_semi").select("doc_id")
        told = flag_possible(self._rows(docs, self.runs), F.col("doc_id"), self.ws.save(ids, "hit-ids"), F.col("doc_id")).where("_maybe")
        told = told.select("doc_id", "run", "norm", "sha", self._key().alias("key"))
        one = told.groupBy("run", "key", "norm").agg(self.best("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
        true = one.groupBy("key", "norm").agg(self.best("best").alias("best"), F.sum("n").alias("n"))
        true = self.ws.save(true, "verified")
        texts = true.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.first("best").alias("vbest"), F.first("n").alias("vn"))
        clash = self.ws.save(texts.where("texts > 1").select("key"), "clashes")
        agreed = index.by_key.join(texts, "key", "left").where("texts is null or texts = 1")
        agreed = agreed.select("key", F.when(F.col("n") > 1, F.col("vbest")).otherwise(F.col("best")).alias("keep_id"), F.when(F.col("n") > 1, F.col("vn")).otherwise(F.lit(1)).cast("long").alias("group_size"))
        at = self.ws.save(index.by_run.select("run", "key").join(agreed, "key"), "answers")
        out = index.entries.withColumn("key", self._key()).join(at, ["run", "key"]).select("doc_id", "sha", "copies", "keep_id", "group_size")
        if clash.isEmpty():
            return out
        # different texts under one digest: their rows are matched by the text itself
        told = told.join(clash, "key", "left_semi").groupBy("doc_id", "sha", "key", "norm").agg(F.count(F.lit(1)).alias("copies"))
        apart = told.join(true.select("key", "norm", F.col("best").alias("keep_id"), F.col("n").alias("group_size")), ["key", "norm"])
        return out.unionByName(apart.select("doc_id", "sha", "copies", "keep_id", "group_size"))

    def decisions(self, docs: DataFrame) -> DataFrame:
        """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

        Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts are equal.
        Of equal texts the row with the best id stays. A null id is never the best unless all are null. Rows
        that repeat id and text count singly in group_size, and one of them at most stays. An empty table gives
        no rows; other columns are not read.
        """
        rows = self.resolve(docs, self.compact(self.flush(docs)))
        each = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))

    def kept_rows(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that stay, with all their columns. Rows whose id has no copy aren't shuffled.

        Null and empty texts are equal; of rows that repeat id and text one stays, whatever their other columns; an
        empty table stays empty.
        """
        rows = self.ws.save(self.resolve(docs, self.compact(self.flush(docs))), "rows")
        mixed = rows.where("group_size > 1")
        names = docs.columns
        id_, sha, maybe, kid, ksha = free_names(docs, "id", "sha", "maybe", "kid", "ksha")
        tagged = docs.withColumns({id_: F.col(self.id_col), sha: F.unhex(F.sha2(normalised(F.col(self.text_col)), 256))})
        told = flag_possible(tagged, F.col(id_), mixed, F.col("doc_id"), maybe)
        stay = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(kid), F.col("sha").alias(ksha))
        again = told.where(maybe).join(stay, F.col(id_).eqNullSafe(F.col(kid)) & (F.col(sha) == F.col(ksha)), "left_semi")
        return told.where(~F.col(maybe)).select(names).unionByName(again.dropDuplicates([id_, sha]).select(names))
