"""Shared pieces: scratch tables in the cluster's folder, a bounded row filter, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one is set only where the session has none and driver and
    executors are one process; elsewhere executors would each write to their own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attestra-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of the Arrow batches that Python workers are sent, about; Spark's own limits are 10,000 rows and 64 MB.
BATCH_BYTES = 2 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> str:
    """From now on the session sends Python workers batches of BATCH_BYTES; one that sends less keeps to that. Returns the
    limit of before. Rows stay in their order, and none is left out."""
    before = spark.conf.get(_BATCHES)
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) <= BATCH_BYTES:
        spark.conf.set(_BATCHES, BATCH_BYTES)
    return before


#: Scratch tables after whose making the driver collects its garbage.
FREE_AFTER = 4


def free_ended(spark: SparkSession) -> None:
    """Broadcast tables of queries that have ended, on the driver and on all executors, and their shuffle files: Spark frees
    them once the driver's collector finds that nothing refers to them, which it seldom looks for of itself."""
    gc.collect()
    spark._jvm.System.gc()


class Workspace:
    """Scratch tables of one operator call. They cut lineage, outlive executors and are read by any of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/attestra-{label}-{uuid.uuid4().hex}"
        self._saved: dict[str, str] = {}
        self._made = 0
        atexit.register(self._at_exit)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        at = self._saved[name] = f"{self.path}/{len(self._saved)}-{uuid.uuid4().hex[:6]}-{name}"
        before = small_batches(self.spark)
        try:
            df.write.options(**options).parquet(at)
        finally:
            self.spark.conf.set(_BATCHES, before)
        self._made += 1
        if self._made % FREE_AFTER == 0:
            free_ended(self.spark)
        return self.spark.read.schema(df.schema).parquet(at)

    def delete(self, name: str = "") -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self._saved.pop(name) if name else self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _at_exit(self) -> None:
        """Scratch tables go with the driver's process, where its JVM still answers."""
        with contextlib.suppress(Exception):
            self.delete()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own, each made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__att_{name}"
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def slices(batches, rows: int = 256):
    """Arrow batches in small pieces, so that what Python makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_held: list = [None, None]


def in_worker(key, make):
    """An object that a Python worker keeps from task to task, such as a table of words met so far. Only the last
    one asked for is kept, so that what one operator gathered makes room for the next one's."""
    if _held[0] != key:
        _held[:] = [None, None]
        _held[:] = [key, make()]
    return _held[1]


#: Bits of the row filter: 262,144 long numbers, however many rows they stand for.
FILTER_BITS = 1 << 24


def flag_possible(df: DataFrame, key: Column, members: DataFrame, member_key: Column, flag: str = "_maybe", bits: int = FILTER_BITS) -> DataFrame:
    """df with a boolean column: false where the key is surely none of the members, true for members and some others.

    A one-hash Bloom filter made and read by SQL functions alone. It has `bits` bits, 64 to a row, which is what
    bounds the broadcast. True needs an exact join to follow; where the filter fills up every row is true and
    nothing is lost.
    """
    row, held, at = free_names(df, "row", "held", "at")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(bits))
    filter_ = (
        members.select(place(member_key).alias(at))
        .groupBy(F.shiftright(at, 6).alias(row))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast({at} & 63 as int))")).alias(held))
    )
    return (
        df.withColumn(at, place(key))
        .withColumn(row, F.shiftright(at, 6))
        .join(F.broadcast(filter_), row, "left")
        .withColumn(flag, F.coalesce(F.expr(f"shiftright({held}, cast({at} & 63 as int)) & 1") == 1, F.lit(False)))
        .drop(at, row, held)
    )


def components(ws: Workspace, edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) links: rows (node, root) with the smallest node of each component as root.

    Every round each node takes the smallest neighbour or itself, edges and labels are renamed by it, and loops
    go; a component shrinks by at least half a round. Minima are combined before the shuffle, and the joins have
    plain exchanges on both sides, so a node with very many links is split by adaptive skew handling. Nulls in
    links are dropped; no links give no rows.
    """
    kind = dict(edges.dtypes)["a"]
    e = ws.save(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), f"{name}-e0")
    labels = None
    for i in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("m"))
        low = ws.save(low.select("n", F.least("n", "m").alias("m")), f"{name}-m{i}")
        if labels is None:
            nxt = low.select(F.col("n").alias("node"), F.col("m").alias("root"))
        else:
            nxt = labels.join(low, labels.root == low.n, "left").select("node", F.coalesce("m", "root").alias("root"))
        labels = ws.save(nxt, f"{name}-l{i}")
        ra, rb = low.select(F.col("n").alias("a"), F.col("m").alias("ra")), low.select(F.col("n").alias("b"), F.col("m").alias("rb"))
        nxt_e = e.join(ra, "a").join(rb, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct()
        e = ws.save(nxt_e, f"{name}-e{i + 1}")
        ws.delete(f"{name}-e{i}")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return ws.spark.createDataFrame([], f"node {kind}, root {kind}")
    return labels


def labelled_sample(labels: DataFrame, docs: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """Texts of at most `limit` labelled documents, by a hash of the id: (doc_id, label, text).

    Rows without id or label are left out; an id labelled twice takes its highest label, and of rows that share
    an id one gives its text. The sample's size is what bounds the broadcast.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    if where is not None:
        chosen = chosen.where(where)
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", "text")
