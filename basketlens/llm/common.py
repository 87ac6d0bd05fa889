"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

#: Spark paths of the tables written by ``materialize`` in this process.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketlens-llm/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet on shared storage and return a scan of it.

    Cuts the lineage: a lost executor costs at most the stage being run, and
    a result used by several branches is computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables ``materialize`` has written and not deleted."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the tables that ``materialize`` wrote after the first ``since``,
    but for the last ``keep``; call it when nothing will read them any more.
    Returns their number."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1_000
#: Ids that may be broadcast, after they have been counted; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000


def prepare(spark: SparkSession) -> None:
    """Settings that the corpus queries run with."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def rows_of(df: DataFrame, ids: DataFrame, id_col: str = "doc_id", without: bool = False) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (one column of that name;
    best a materialized table: it is counted), or those whose id isn't. Few
    ids are broadcast, so that the rows aren't shuffled; many are joined."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, id_col, "left_anti" if without else "left_semi")


def bounded_rows(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` if they are at most ``most``; else those with the least hashes
    of all columns, equal rows once. Only hashes are counted and sorted."""
    mark = free_name(rows, "hash")
    marked = rows.withColumn(mark, F.xxhash64(*rows.columns, F.lit(11)))
    hashes = marked.groupBy(mark).agg(F.count(F.lit(1)).alias("rows"))
    n = hashes.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("kinds")).first()
    if (n["rows"] or 0) <= most:
        return rows
    if n["kinds"] > most:
        marked = marked.where(F.col(mark) <= hashes.orderBy(mark).limit(most).agg(F.max(mark)).first()[0])
    return marked.dropDuplicates([mark]).drop(mark)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def add_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], compute: Callable[..., list[pa.Array]],
                drop: tuple[str, ...] = (), rows: int = 256) -> DataFrame:
    """``df`` with columns computed in Arrow batches from the ``inputs``, a
    map-only job. A column of ``df`` that has the name of a new one is
    replaced; ``drop`` names columns to leave out. At most ``rows`` rows are
    given to ``compute`` at a time."""
    new = {f.name.lower() for f in fields}
    rest = [c for c in df.columns if c.lower() not in new and c not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = compute(*(part.column(part.schema.get_field_index(c)) for c in inputs))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in rest), *made], names=[*rest, *(f.name for f in fields)])

    # only what is needed goes to the workers
    needed = df.select(*[F.col(f"`{c}`") for c in df.columns if c in rest or c in inputs])
    return needed.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), *fields]))


def crc_remainder(col, mod: int):
    """crc32 of the id as text, modulo ``mod`` (the held-out fold rule)."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(mod)
