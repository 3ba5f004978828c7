"""What the corpus operators share: written intermediate tables and graph components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeforge.schema import unused  # noqa: F401  (the operators take it from here)

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; in local mode one is set where the session names none
    (as the context's, since a running session's own setting can't be changed)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="cladeforge-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Folders of tables written and not dropped yet, in turn.
_written: list[str] = []


def write_table(df: DataFrame, **options) -> DataFrame:
    """Write df as Parquet (with the writer's options) in the shared folder and read it back.

    Cuts the lineage: later jobs reread files that outlive any executor instead of
    computing df again. So the shuffle files of the writing job have no further use and
    are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cladeforge/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a table of write_table() that no later result reads."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _written[:] = [p for p in _written if p.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]
        _remove(df.sparkSession, folder)


def written_tables() -> int:
    """How many tables are written and not dropped; for drop_since()."""
    return len(_written)


def drop_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Remove the tables written since there were `mark`, but the one behind `keep`."""
    kept = {name.rsplit("/", 2)[1] for name in keep.inputFiles()}
    for path in _written[mark:]:
        if path.rsplit("/", 1)[1] not in kept:
            _remove(spark, path)
    _written[mark:] = [p for p in _written[mark:] if p.rsplit("/", 1)[1] in kept]


def _star_round(pairs: DataFrame) -> DataFrame:
    """Pairs a > b with the components of the given ones, nearer to stars.

    First the larger neighbours of every node move to its smallest one, then all but the
    smallest of the smaller ones do. A round about halves the paths of a component.
    """
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as columns a, b (long).

    Returns node, root for every node with an edge, root being the smallest node of
    its component. Self loops and repeated edges are allowed; nulls are dropped.

    Rounds of two star steps until the pairs stay the same, their number growing with the
    logarithm of the longest path. No step gathers a node's neighbours, so hubs only meet
    in partial minima and joins that Spark may split.
    """
    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    pairs = write_table(edges.where("a is not null and b is not null and a <> b").select(hi, lo).distinct())
    before, now = None, _digest(pairs)
    while now[0] and now != before:
        after = write_table(_star_round(pairs))
        drop_table(pairs)
        pairs, before, now = after, now, _digest(after)
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
