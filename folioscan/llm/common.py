"""Shared helpers of the training-data operators: tables, the shared folder, staged tables, row numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Staged tables of this driver, oldest first.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting (a
    test, as a rule) gets a temporary folder of its own; any other one is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="folioscan-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written table.

    This cuts the lineage: an executor that is lost later costs a re-read and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns, then remove the tables that were staged on the way to it."""
    first = len(_written)
    out = staged(make(), name)
    spark = out.sparkSession
    for path in _written[first:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _written[first:-1]
    return out


def fresh(columns: list[str], *bases: str) -> list[str]:
    """Names like ``bases`` that no column has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, column: str, name: str) -> DataFrame:
    """``docs`` written once with a number for each row, which holds from then on."""
    return staged(docs.withColumn(column, F.monotonically_increasing_id()), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tasks(units: int) -> int:
    """Tasks for so many units of work: one each, some to a task where there are very many."""
    return max(1, min(units, 4096), units // 16)


def held_out(doc_id: str, modulus: int, remainder: int):
    """The fold of the contract: crc32 of the id's decimal text."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus == remainder


def bounded_ids(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """At most ``size`` distinct doc_ids of ``rows``, chosen by a hash of them; for fitting a classifier.

    A share of the ids is taken first, half as many again as wanted, so that no task gathers
    ``size`` rows from every other one.
    """
    order = F.xxhash64("doc_id", F.lit(salt))
    total = rows.count()
    if total > 2 * size:
        rows = rows.filter(F.pmod(order, F.lit(1 << 30)) < int((1 << 30) * 1.5 * size / total))
    return rows.select("doc_id").distinct().orderBy(order, "doc_id").limit(size)
