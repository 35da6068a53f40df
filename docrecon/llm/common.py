"""Shared helpers: intermediate tables in the cluster's shared folder, and Arrow text batches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Workers need not have the package installed: functions of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Python workers outlive tasks; tables that cost time to build are kept under this name.
_KEPT = "docrecon_llm_kept"

#: Spark's setting to delete the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder is set for a local master only; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="docrecon-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: a lost executor costs no recomputation of what came before, and nothing reads
    the shuffle files behind the table again, so Spark deletes them as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docrecon-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new plan, as a plan keeps the setting of its birth
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``settled`` wrote.  Nothing that is still to run may read them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def kept(key, make):
    """``make()``, once per worker process and key; one value per name (``key[0]``) is kept."""
    store = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    name = key[0]
    if name not in store or store[name][0] != key:
        store[name] = (key, make())
    return store[name][1]


def unkept() -> None:
    """Drop what other operators keep in this worker process, so that their memory does not add up."""
    store = sys.modules.get(_KEPT, types.ModuleType(_KEPT)).__dict__
    for name in [k for k, v in store.items() if isinstance(v, tuple)]:
        del store[name]


def raw_texts(column) -> list:
    """Texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


def sliced(batches, rows: int):
    """The same rows in batches of at most ``rows``, so that little is held in Python at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_map(df: DataFrame, work, ddl: str, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """Rows of ``df`` with what ``work`` makes of their texts.

    ``work`` gets lists of texts and yields one Arrow batch of the columns ``ddl`` for each.  The
    result has the id as well or, with ``keep``, ``row`` with all columns of the input.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row") if keep else \
        F.col(f"`{id_col}`").cast("long").alias("row")
    rows = df.select(own, F.col(f"`{text_col}`").alias("text"))

    def mapped(batches):
        waiting = []

        def texts():
            for b in batches:
                waiting.append(b.column("row"))
                yield b.column("text").to_pylist()

        for made in work(texts()):
            yield pa.RecordBatch.from_arrays(
                [waiting.pop(0), *made.columns], names=["row", *made.schema.names])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.mapInArrow(mapped, f"row {kind}, {ddl}")
    return out if keep else out.withColumnRenamed("row", id_col)
