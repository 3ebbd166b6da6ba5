"""Shared-folder tables, blocks of pair work and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given. Where
    neither is set, a folder of our own serves in local mode, in which there is one machine only; a cluster is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="barloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/barloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has stored; for when no result is to be read any more."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


ROWS_A_FILE = 20_000  # of tables of short rows


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, survives lost executors, and is read only as needed.
    rows: about how many short rows there are at most, where that is known and their work is small; few of them make few
    files instead of one a shuffle partition."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None and (files := -(-rows // ROWS_A_FILE)) < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.coalesce(max(1, files))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._barloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote for df."""
    path = getattr(df, "_barloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def tidy() -> None:
    """Gives memory that a Python worker has freed back to the system; workers stay for the next stage's tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A free column name for each of names, whatever columns df has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


#: Rows that a scan, and an exchange with Python, take at a time (and Spark's own numbers): rows of whole texts are long,
#: and a batch of thousands of them fills an executor's heap with large arrays.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": ("512", "4096"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000")}


def long_rows(df: DataFrame) -> DataFrame:
    """df, and its session set to batches that suit rows of whole texts, unless it has numbers of its own."""
    conf = df.sparkSession.conf
    for key, (few, usual) in BATCHES.items():
        if conf.get(key, usual) == usual:
            conf.set(key, few)
    return df


def bucket(col: Column | str, m: int) -> Column:
    """crc32 of a value as text, modulo m; a null counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def hash_share(col: Column, share: float) -> Column:
    """A predicate that holds for about this share of the values, the same ones in every run; shares down to 2^-40."""
    h, half = F.xxhash64(col), F.lit(1 << 20)
    return F.pmod(h, half) * half + F.pmod(F.shiftright(h, 20), half) < F.lit(int(min(1.0, share) * (1 << 40)))


HOT_LEAST = 256  # rows of a key that any task may have


def hot_keys(counts: DataFrame, key: str, rows: str = "rows") -> DataFrame | None:
    """The keys with more rows than a quarter of an even partition, or None if there are none. counts: a row a key, with
    its rows. There can't be more than four of them a partition, so they may be broadcast."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = counts.agg(F.sum(rows).alias("n"), F.max(rows).alias("top")).first()
    most = max(HOT_LEAST, (seen["n"] or 0) // (4 * parts))
    return counts.where(F.col(rows) > most).select(key) if (seen["top"] or 0) > most else None


def hot_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "inner", rows: str = "rows") -> DataFrame:
    """left joined by `key` to right, which has a row a key at most, so that no task gets all rows of a key that very many
    of left's have: hot_keys of `counts` (a row a key, with left's rows of it) meet their row of right by a broadcast,
    the others by a shuffle. Null keys match nothing; how="left" keeps them, where they are."""
    new = [f for f in right.schema.fields if f.name != key]
    real = left.where(F.col(key).isNotNull())
    hot = hot_keys(counts, key, rows)
    if hot is None:
        out = real.join(right, key, how)
    else:
        out = real.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
        if how == "left":  # a hot key that right lacks
            lost = hot.join(right.select(key), key, "left_anti")
            out = out.unionByName(real.join(F.broadcast(lost), key, "left_semi").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new]))
        out = out.unionByName(real.join(F.broadcast(hot), key, "left_anti").join(right, key, how))
    if how == "left":
        bare = left.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
        out = out.unionByName(bare)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of the edges; comp is the smallest node that links reach.

    Each round takes the smallest label among a node and its neighbours, then follows labels once more. Aggregates have
    partial results; a node with very many links, and a label that very many nodes have, meet their rows by a broadcast
    of such nodes only (hot_keys), so neither costs a task all of its rows. Rounds are about the logarithm of the
    longest path, and each is stored in the shared folder; nothing but counts comes to the driver."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    n = both.count()
    degrees = stored(both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")), "degrees", n)
    labels = stored(degrees.select(F.col("v").alias("node"), F.least("v", "m").alias("comp")), "labels", n)
    many_nodes = degrees.count() > HOT_LEAST
    hubs = hot_keys(degrees, "v") if many_nodes else None
    few = both.join(F.broadcast(hubs), "v", "left_anti") if hubs is not None else both
    many = both.join(F.broadcast(hubs), "v", "left_semi") if hubs is not None else None
    while True:
        at = labels.select(F.col("node").alias("v"), "comp")
        near = few.join(at, "v").select("u", "comp")
        if hubs is not None:
            near = near.unionByName(many.join(F.broadcast(at.join(F.broadcast(hubs), "v", "left_semi")), "v").select("u", "comp"))
        near = near.groupBy("u").agg(F.min("comp").alias("m"))
        step = stored(labels.join(near, labels.node == near.u).select("node", F.least("comp", "m").alias("c"), F.col("comp").alias("old")), "step", n)
        root = step.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        # a label is a node of the same component, so the second look-up never misses
        sizes = step.groupBy("c").agg(F.count(F.lit(1)).alias("rows"))
        found = hot_join(step, root, "c", sizes) if many_nodes else step.join(root, "c")
        new = stored(found.select("node", F.col("cc").alias("comp"), (F.col("cc") != F.col("old")).alias("moved")), "labels", n)
        forget(step)
        forget(labels)
        labels = new
        if not labels.where("moved").limit(1).count():
            forget(both)
            forget(degrees)
            out = labels.select("node", "comp")
            out._barloom_path = labels._barloom_path
            return out


def pair_blocks(nodes: DataFrame, group: str, key: str, size: int, fn: Callable, schema: str) -> DataFrame:
    """Runs fn over pairs of blocks, so that every two rows of one group meet in exactly one call or more.

    A group of over `size` rows is dealt by a hash of the key into blocks of about `size` rows, and every two blocks
    meet in a task of their own; smaller groups are gathered, some to a call. fn gets a frame with columns gr (the
    group), side (0, 1: the row's block is the first, the second of the two; 2: both, compare inside) and the nodes'
    columns, and compares rows within a group only: inside side 2, or side 0 with side 1. No group is ever gathered in
    one task, and fn returns counts and spanning links, never all pairs."""
    n = F.count(F.lit(1))
    sizes = nodes.groupBy(group).agg(n.alias("rows")).withColumn("nb", F.ceil(F.col("rows") / size).cast("int"))
    sizes = stored(sizes, "sizes", nodes.count())
    small = sizes.where("nb = 1").agg(F.sum("rows").alias("n")).first()["n"] or 0
    parts = max(1, -(-4 * small // size))
    at = hot_join(nodes, sizes.select(group, "nb"), group, sizes).withColumnRenamed(group, "gr")
    at = at.withColumn("blk", F.pmod(F.xxhash64(key), F.col("nb")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    at = at.withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
    at = at.withColumn("side", F.when(F.col("bi") == F.col("bj"), 2).when(F.col("blk") == F.col("bi"), 0).otherwise(1))
    job = F.when(F.col("nb") == 1, F.pmod(F.xxhash64("gr"), F.lit(parts))).otherwise(F.xxhash64("gr", "bi", "bj"))
    at = at.withColumn("job", job).withColumn("many", F.col("nb") > 1).drop("other", "nb", "blk", "bi", "bj")
    return at.groupBy("many", "job").applyInPandas(fn, schema)


class Forest:
    """Union of integers, to keep only links that join two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
