"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, app: str = "codeloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster; one of our own only where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        # One machine shares its own folders; a cluster must name one that all its machines see.
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="codeloom-checkpoints-")
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and return it with its row count (and any further ``metrics``).

    One job writes the rows to the shared folder and counts them on the way, so a lost
    executor costs a re-read, not a recomputation of the whole lineage.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    columns = [F.count(F.lit(1)).alias("rows")] + [c.alias(n) for n, c in metrics.items()]
    done = df.observe(seen, *columns).checkpoint(eager=True)
    return done, seen.get


def written(df: DataFrame, name: str, by: str | None = None, packed: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for frames that are read many times: a short plan,
    columnar scans, and nothing to recompute when an executor is lost. ``by`` names a column of few values that readers
    filter on; its values get folders of their own. ``packed``: made smaller at some cost in time, as long strings ask for."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd") if packed else df.write
    if by is None:
        writer.parquet(path)
    else:
        # a file open for each value, as rows need not be sorted by it then
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(FILES_AT_ONCE)):
            writer.partitionBy(by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


#: Values of a ``by`` column for which a task keeps a file open; rows of further ones are sorted.
FILES_AT_ONCE = 8


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within it, a setting of the session has this value, for a job that runs at once."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Rows of a bucket, about; smaller tables get buckets enough to keep the cores busy.
BUCKET_ROWS, LEAST_BUCKET_ROWS = 8_000_000, 50_000


def bucket_number(spark: SparkSession, rows: int) -> int:
    """Into how many buckets a table of so many rows goes."""
    return max(math.ceil(rows / BUCKET_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(rows / LEAST_BUCKET_ROWS)), 1)


def write_bucketed(df: DataFrame, path: str, columns: list[str], n: int) -> None:
    """``df`` under ``path``, dealt by a hash of ``columns`` into n buckets and sorted in each."""
    table = f"codeloom_{uuid.uuid4().hex}"
    (df.repartition(n, *columns).write.format("parquet").bucketBy(n, *columns).sortBy(*columns)
     .option("path", path).saveAsTable(table))
    df.sparkSession.sql(f"DROP TABLE {table}")  # the name only: the files stay


def open_bucketed(spark: SparkSession, path: str, schema: str, columns: list[str], n: int) -> DataFrame:
    """A table that ``write_bucketed`` has written, also by another session: joins on its columns never shuffle it, and
    filters on them read only the buckets they need."""
    table, by = f"codeloom_{uuid.uuid4().hex}", ", ".join(columns)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {n} BUCKETS "
              f"LOCATION '{path}'")
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the frame knows how the files lie
    return found


def bucketed(df: DataFrame, name: str, columns: list[str], rows: int) -> DataFrame:
    """``df``, of so many rows, as a bucketed table in the shared folder."""
    spark = df.sparkSession
    path, n = scratch_path(spark, name), bucket_number(spark, rows)
    write_bucketed(df, path, columns, n)
    return open_bucketed(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), columns, n)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file, whole or not at all, unless there is one: of several writers at once, one gets True."""
    from py4j.protocol import Py4JJavaError

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(conf)
    target = fs.makeQualified(hadoop.Path(path))
    fs.mkdirs(target.getParent())
    # beside the folder, so that nobody who lists it sees the draft
    draft = hadoop.Path(target.getParent().getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, draft)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
            options[0] = getattr(hadoop, "Options$Rename").NONE
            hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


#: How often scratch tables were deleted; frames kept from before are of no use.
cleared = 0


def files_state(spark: SparkSession, *paths: str) -> tuple:
    """What changes when the files under some paths do: their names, sizes and times, and ``cleared``."""
    found: list = [cleared]
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        for status in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(found)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the checkpoints and helper tables of this session; frames that were made from them can't be read any more."""
    global cleared
    cleared += 1
    folder = shared_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
