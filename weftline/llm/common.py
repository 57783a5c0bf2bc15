"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Texts longer than this many bytes are not taken into the bounded samples that models are fitted on; they are scored whole.
FIT_BYTES = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, else the checkpoint folder set on its context.

    Only where neither is named and the master is local (tests, one machine) a folder of its own is
    made and removed at exit; on a cluster that is an error, as executors wouldn't share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        path = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local.append(f"file://{path}")
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    It ends the lineage like checkpoint(), but keeps columns apart, so that later
    readers prune them, and outlives the loss of executors.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` has written, once nothing reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """For each name a column name that isn't among ``columns``, whatever those are called."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def held_out_by(doc_id: Column, mod: int, rest: int) -> Column:
    """The split of the contracts: crc32(doc_id as text) mod ``mod`` is ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == rest, F.lit(False))


def hash_sample(rows: DataFrame, by: str, per: int, order: Column, most: int | None = None) -> list[Row]:
    """At most ``per`` rows of each value of ``by``, those with the smallest ``order`` hashes, on the driver; with
    ``most``, fewer of each (one at least) where there are so many values that the whole would be larger.

    A hash threshold from exact counts picks about 1.2 times as many rows where they lie;
    nothing is ranked or gathered by value, so a hot value costs no more than another.
    """
    counts = rows.groupBy(F.col(by).alias("_value")).agg(F.count("*").alias("_n"))
    counts = rows.sparkSession.createDataFrame(counts.toArrow())
    if most is not None:
        per = max(1, min(per, most // max(counts.count(), 1)))
    counts = counts.select("_value", ((1.2 * per + 40) / F.col("_n")).alias("_share"))
    place = F.shiftright(order, 1).bitwiseAND(2**52 - 1).cast("double") / float(2**52)
    picked = rows.withColumn("_order", place).join(F.broadcast(counts), F.col(by) == F.col("_value")).where("_order < _share").drop("_value", "_share").collect()
    taken: dict = {}
    out = []
    for r in sorted(picked, key=lambda r: (str(r[by]), r["_order"])):
        taken[r[by]] = taken.get(r[by], 0) + 1
        if taken[r[by]] <= per:
            out.append(r)
    return out


def in_blocks(df: DataFrame, keys: list[str], order: list[str], most: int, fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Call ``fn`` on blocks of at most ``most`` rows that share ``keys`` and follow each other in ``order``; a block begins with the last row of the one before.

    Rows are exchanged by ranges of keys and order together, so that a hot key is spread over tasks; a block ends where a task's range does."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held: pa.Table | None = None
        new = 0  # rows of ``held`` that no block has had yet

        def ready(t: pa.Table) -> Iterator[pa.RecordBatch]:
            out = fn(t.combine_chunks())
            if out is not None and out.num_rows:
                yield from out.to_batches()

        for batch in it:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t, new = pa.concat_tables([held, t]), new + t.num_rows
            else:
                new = t.num_rows
            if not t.num_rows:
                continue
            change = np.zeros(t.num_rows, dtype=bool)
            for k in keys:
                v = t.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            starts = [*np.flatnonzero(change).tolist(), t.num_rows]
            a, old = 0, t.num_rows - new
            for b in starts:
                while b - a > most:
                    yield from ready(t.slice(a, most))
                    a, old = a + most - 1, a + most
                if b < t.num_rows:
                    if b - a > 1 and b > old:
                        yield from ready(t.slice(a, b - a))
                    a = old = b
            held, new = t.slice(a), t.num_rows - max(old, a)
        if held is not None and held.num_rows > 1 and new:
            yield from ready(held)

    return df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).mapInArrow(batches, schema)


def in_groups(
    df: DataFrame,
    keys: list[str],
    fn: Callable[[pa.Table], pa.Table | None],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Call ``fn`` once for each group of equal ``keys``.

    One exchange by key and a sort, then groups are cut out of the Arrow batches. Far
    cheaper than grouped pandas calls for many small groups. The caller bounds the
    group size; a task holds one batch and one group at a time.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rest: list[pa.RecordBatch] = []

        def ready(t: pa.Table) -> Iterator[pa.RecordBatch]:
            out = fn(t.combine_chunks())
            if out is not None and out.num_rows:
                yield from out.to_batches()

        last = None
        for batch in it:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in cols:
                v = c.to_numpy(zero_copy_only=False)
                change[1:] |= v[1:] != v[:-1]
            first = tuple(c[0].as_py() for c in cols)
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                piece = batch.slice(a, b - a)
                if a == 0 and last is not None and first != last and rest:
                    yield from ready(pa.Table.from_batches(rest))
                    rest = []
                elif a > 0 and rest:
                    yield from ready(pa.Table.from_batches(rest))
                    rest = []
                rest.append(piece)
            last = tuple(c[batch.num_rows - 1].as_py() for c in cols)
        if rest:
            yield from ready(pa.Table.from_batches(rest))

    parts = [partitions] if partitions else []
    return df.repartition(*parts, *keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)
