"""What several operators of this subpackage share: the cluster's shared folder,
cutting of lineage, range-sorted row numbers and connected components."""

from __future__ import annotations

import atexit
import ctypes.util
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


#: Tables in the shared folder that still have their files.
_tables: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and the master is local (tests) a temporary
    folder of this machine is set in its place; on a cluster that is an error, as
    executors would write where nobody reads.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="marlow-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans start from the
    files, so a lost executor costs no recomputation and nothing is run twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    _tables.append(path)
    return out


def small(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """A table of few rows from the driver, as a local relation: no Python worker reads it."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = [to_arrow_type(f.dataType) for f in kinds]
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kinds.fieldNames()), kinds)


def lasting(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives, written; the tables that it wrote on the way are removed."""
    mark = len(_tables)
    out = written(build())
    for path in _tables[mark:]:
        if path != out.written_path:
            _tables.remove(path)
            _delete(out.sparkSession, path)
    return out


def forget_all(spark: SparkSession) -> None:
    """Remove the files of all tables that this driver wrote and still has: for long
    sessions, once the results that read them are stored."""
    while _tables:
        _delete(spark, _tables.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Remove the files of a table made by :func:`written`."""
    path = getattr(df, "written_path", None)
    if path in _tables:
        _tables.remove(path)
        _delete(df.sparkSession, path)


def lean(batches: Iterator) -> Iterator:
    """The result batches of a task, after whose last one the Python worker gives the memory it
    holds back to the system: workers outlive their tasks, and stages without Python
    then have it."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(df: DataFrame, *extra: Column) -> DataFrame:
    """``df`` as one struct column ``row`` beside ``extra``: no name of its own can then
    clash with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *extra)


def unpacked(names: list[str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns ``names`` of ``row``, but those ``without``."""
    return [F.col(f"row.`{c}`").alias(c) for c in names if c not in without]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key that tells rows apart by id and text, a null id too; in its order a null id is the last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(text).isNull().alias("bare"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("digest"))


def numbered(df: DataFrame, order: list[Column], grouped: bool = False) -> DataFrame:
    """(row, k0, k1, ..., rank): each row of ``df`` as a struct, its order keys, and its
    gapless place from 0 in their order; with ``grouped`` the place among the rows of equal k0.

    The rows are range-partitioned on all keys, so that a hot group is spread over many
    tasks as long as the last keys tell its rows apart; rows equal in all of them
    change places freely.  The driver sees one count for each partition (and
    group), never rows.
    """
    spark = df.sparkSession
    keys = [f"k{i}" for i in range(len(order))]
    laid = packed(df, *[c.alias(k) for c, k in zip(order, keys)])
    placed = written(laid.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("at", 33).cast("int"))
    counts = placed.groupBy("part", *(["k0"] if grouped else [])).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    base: list[tuple] = []
    seen: dict = {}
    for r in sorted(counts.collect(), key=lambda r: r["part"]):
        g = r["k0"] if grouped else None
        base.append((r["part"], g, r["first"], seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + r["n"]
    kind = dict(placed.dtypes)["k0"] if grouped else "string"
    bases = F.broadcast(small(spark, base, f"part int, g {kind}, first long, base long"))
    on = placed["part"] == bases["part"]
    if grouped:
        on = on & placed["k0"].eqNullSafe(bases["g"])
    return placed.join(bases, on).select("row", *keys, (placed["at"] - bases["first"] + bases["base"]).alias("rank"))


def _kept(df: DataFrame) -> DataFrame:
    """:func:`written` in an eighth as many files as a shuffle has partitions (twice the cores at least): the many
    small tables of a contraction.  On a local file system each file starts a process, in whose first moment
    the memory of its executor counts twice."""
    spark = df.sparkSession
    return written(df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffle_width(spark) // 8)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b; any orderable type, either way
    round): one row (node, root) for each node named by an edge, root being the
    smallest node of its component.

    Contraction by minimum neighbours: every node points at the least of itself
    and its neighbours (a forest, as pointers only fall), pointer jumping makes
    each tree flat, and edges between different roots go to the next level.  All
    steps are joins and ``min`` aggregates, so a hub is combined on the map side
    and its neighbour list never stands in one place.  Each level is written to
    the shared folder, in few files; nothing is collected but row counts.
    """
    a, b = F.col("a"), F.col("b")
    live = _kept(edges.select(a, b).where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    result = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        while True:  # pointer jumping
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = _kept(up.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            moved = not jumped.where("moved").isEmpty()
            forget(up)
            up = jumped.select("node", "root")
            up.written_path = jumped.written_path
            if not moved:
                break
        if result is None:
            result = up
        else:
            nxt = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            merged = _kept(result.join(nxt, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
            forget(result)
            result = merged
        ra, rb = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt_live = _kept(live.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        forget(live)
        live = nxt_live
    if result is None:
        kind = edges.schema["a"].dataType.simpleString()
        return small(edges.sparkSession, [], f"node {kind}, root {kind}")
    return result
