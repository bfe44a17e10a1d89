"""What the operators of this subpackage share: tables, folds, shared scratch tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size, in bytes, of anything that these operators broadcast; beyond it each has another way.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids are as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, longer by as many underscores as it takes to be none of the columns ``taken`` (in any case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def cols(names: Iterable[str]) -> list[Column]:
    """Columns of these very names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def beside(df: DataFrame, keep: list[str], inputs: list[Column], added: dict[str, str], start: Callable) -> DataFrame:
    """Columns ``keep`` of ``df``, of any names, with the columns ``added`` (name -> type) that Python workers make.

    ``start()`` is called in each task and gives a function of the Arrow arrays of ``inputs`` for a batch of rows; it
    yields (rows, columns): a slice or a list of the batch's rows, and for each column added its values for these rows.
    Workers see no column's own name, since Spark looks names with dots up as fields when it hands tables to Python.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    kept = df.select(*(c.alias(f"k{k}") for k, c in enumerate(cols(keep))))
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(", ".join(f"x{k} {t}" for k, t in enumerate(added.values())))])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator) -> Iterator:
        work = start()
        for batch in batches:
            for rows, made in work(batch.columns[n:]):
                own = [c.slice(rows.start, rows.stop - rows.start) if isinstance(rows, slice) else c.take(pa.array(rows, pa.int64())) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip([*own, *made], arrow, strict=True)], schema=arrow)

    given = [c.alias(f"k{k}") for k, c in enumerate(cols(keep))] + [c.alias(f"i{k}") for k, c in enumerate(inputs)]
    return df.select(*given).mapInArrow(run, schema).toDF(*keep, *added)


#: Rows that Python workers get at once: texts may be long, and a batch is held by Spark and by the worker.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Keep the batches between Spark and its Python workers small.

    Spark reads the setting when it plans an action, and the operators return plans, so it has to stay lowered in the
    caller's session; a setting that is lower already is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: Folder of each application that has no ``spark.checkpoint.dir``.
_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir`` where it is set.

    Only where it is unset (tests, a single machine) a temporary folder takes its place; the session's settings stay
    as they are.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="veldra-")
        root = _OWN[app]
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors, and gives
    later plans the true size of the table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/veldra/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing will read again; other tables are left alone."""
    for df in tables:
        where = getattr(df, "_scratch", None)
        if where:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def forest(pairs) -> list[tuple[int, int]]:
    """(node, smallest node of its group) for every node of ``pairs`` but the smallest ones; union-find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up)]


def _contract(batches):
    """Reduce the edges of a partition to a spanning forest.  Memory: two integers per node of the partition."""
    import pandas as pd

    pairs: list[tuple[int, int]] = []
    for batch in batches:
        pairs += zip(batch["a"].tolist(), batch["b"].tolist(), strict=True)
        if len(pairs) > 500_000:
            pairs = forest(pairs)
    out = forest(pairs)
    yield pd.DataFrame({"a": [x for x, _ in out], "b": [y for _, y in out]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of ``edges`` (columns a, b: long); root is the smallest node reachable.

    Alternating large-star and small-star rounds, each contracted within its partitions first; every round is
    written to the shared folder, and the round before it is deleted.  No group of edges is gathered in one task:
    minima are partial aggregates and the joins on a node are ones that adaptive execution may split.  ``discard``
    deletes what the result reads.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    now = materialize(now.mapInPandas(_contract, "a long, b long").distinct())
    while True:
        # large star: every neighbour that is greater than u links to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its lesser neighbours link to the smallest of these
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(new.mapInPandas(_contract, "a long, b long").distinct())
        discard(now)
        # done when every node has one root and no root is itself below another
        if new.groupBy("a").count().where("count > 1").isEmpty() and new.join(new.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            roots = new.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
            out = new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
            out._scratch = new._scratch
            return out
        now = new
