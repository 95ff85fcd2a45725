"""Session defaults, the shared scratch folder and skew-aware joins.

Nothing here assumes one machine: scratch tables go to the folder named by
``spark.checkpoint.dir``, which every executor can reach, so a lost executor
never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot when it holds more rows than this.
HOT_ROWS = 50_000
#: Hot keys that are broadcast at most; beyond that each is salted into SALTS tasks.
MOST_HOT = 20_000
SALTS = 32

_runs: dict[str, str] = {}


def session(app: str = "mnemosaic", cores: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the queries are tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package: where PYTHONPATH does not have it, Spark sends it to each executor, once for an application."""
    app, root = spark.sparkContext.applicationId, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(app)
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), f"{package}.zip")  # the driver serves it from here
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(os.path.join(root, package)):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder serves, but only in local
    mode: on a cluster the executors could not see it.
    """
    app = spark.sparkContext.applicationId
    if app not in _runs:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="mnemosaic-")
        path = f"{root.rstrip('/')}/mnemosaic-{uuid.uuid4().hex}"
        _runs[app] = path
        atexit.register(_remove, weakref.ref(spark), path)
    return _runs[app]


def _remove(ref, path: str) -> None:
    try:
        spark = ref()
        if spark is not None and spark.sparkContext._jsc is not None:
            fs_delete(spark, path)
    except Exception:  # the JVM is gone; the cluster's own cleaner has to take over
        pass


def fs_of(spark: SparkSession, path: str):
    """The Hadoop file system and path object of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fs_delete(spark: SparkSession, path: str) -> None:
    fs, p = fs_of(spark, path)
    fs.delete(p, True)


def fs_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, p = fs_of(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def fs_list(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if there is no such folder."""
    fs, p = fs_of(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def fs_stamp(spark: SparkSession, path: str) -> tuple:
    """Path, size and time of a file or folder: equal as long as it wasn't written again."""
    fs, p = fs_of(spark, path)
    status = fs.getFileStatus(p)
    files = list(fs.listStatus(p)) if status.isDirectory() else [status]
    return (path, sum(f.getLen() for f in files), max([status.getModificationTime(), *(f.getModificationTime() for f in files)]))


def fs_create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file so that readers find it whole, and only if there is none of that name; whether this call did.

    The file is renamed into place without overwriting. HDFS does that in one
    step; on an object store it needs a committer or a lock that makes renames
    exclusive, or a single writer.
    """
    jvm = spark._jvm
    fs, final = fs_of(spark, path)
    fs.mkdirs(final.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    never = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(final), never)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(tmp, False)
        return False


def bucketed_files(spark: SparkSession, schema: T.StructType, files: list[str], buckets: int, key: str) -> DataFrame:
    """Parquet files written with Spark's bucketing by ``key``, as a table that keeps it: a join on the key doesn't shuffle them.

    A catalog table would be its whole folder; here it is just these files.
    """
    if not files:
        return spark.createDataFrame([], schema)
    jvm, session = spark._jvm, spark._jsparkSession
    sources, convert = jvm.org.apache.spark.sql.execution.datasources, jvm.scala.jdk.javaapi.CollectionConverters

    def seq(items):
        out = jvm.java.util.ArrayList()
        for x in items:
            out.add(x)
        return convert.asScala(out).toSeq()

    def module(of, name):
        return getattr(getattr(of, f"{name}$"), "MODULE$")

    kind, some, none = session.parseDataType(schema.json()), jvm.scala.Some, module(jvm.scala, "None")
    options = module(jvm.scala.collection.immutable, "Map").empty()
    index = sources.InMemoryFileIndex(session, seq(jvm.org.apache.hadoop.fs.Path(f) for f in files), options, some(kind), module(sources, "NoopCache"), none, none)
    spec = jvm.org.apache.spark.sql.catalyst.catalog.BucketSpec(buckets, seq([key]), seq([key]))
    relation = sources.HadoopFsRelation(index, jvm.org.apache.spark.sql.types.StructType(), kind, some(spec), sources.parquet.ParquetFileFormat(), options, session)
    return DataFrame(session.baseRelationToDataFrame(relation), spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and the rows survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs_delete(df.sparkSession, path)


def broadcast_if_below(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows, else leave the strategy to the optimizer."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """The values of ``key`` with more than ``hot_rows`` rows, all of them, as a written table."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    counts = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return materialize(counts.where(F.col("count") > hot_rows).select(key), "hot")


def skew_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot_rows: int | None = None, hot: DataFrame | None = None) -> DataFrame:
    """Equi-join with a ``right`` that is unique in ``key``, whose hot left keys never meet in one task.

    Up to MOST_HOT hot keys are broadcast with the right rows they need, and
    their left rows stay where they are; all others are shuffled. More hot keys
    than that are salted: their left rows are spread over SALTS tasks a key, to
    each of which the right row goes. ``hot`` gives a table of the hot keys that
    is known already.
    """
    hot = hot_keys(left, key, hot_rows) if hot is None else hot
    n = hot.limit(MOST_HOT + 1).count()
    if not n:
        return left.join(right, key, how)
    if n > MOST_HOT:
        marked = left.join(hot.withColumn("__hot", F.lit(True)), key, "left")
        salted = marked.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(0)).drop("__hot")
        spread = right.join(hot.withColumn("__hot", F.lit(True)), key, "left")
        spread = spread.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
        return salted.join(spread, [key, "__salt"], how).drop("__salt")
    few = F.broadcast(hot)
    there = F.broadcast(right.join(few, key, "left_semi"))
    return left.join(few, key, "left_anti").join(right, key, how).unionByName(left.join(few, key, "left_semi").join(there, key, how))


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """Add ``name``: first, first + 1, ... in the order of the columns ``order``, by a range sort and the sizes of its partitions."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.select("__pid", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inner = F.row_number().over(Window.partitionBy("__pid").orderBy(*order))
    return ranged.join(broadcast_if_below(sizes, 100_000), "__pid").withColumn(name, inner + F.col("__ahead") + F.lit(first - 1)).drop("__pid", "__ahead")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_utf8(content: Column) -> Column:
    """The text of a binary column, NULL where the bytes are not UTF-8."""
    return F.when(F.expr("true") & F.is_valid_utf8(content.cast("string")), content.cast("string"))
