"""What the operators share: inputs, staged tables, word blocks, label samples and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Bytes of a text that are split into words at once; a longer text is handled piece by piece.
BLOCK_BYTES = 1 << 20
_SPACES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own if all of Spark is this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tempora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staged(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, so a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/tempora/{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop_staged(df: DataFrame | None) -> None:
    """Deletes a table made by staged() that nothing reads any more."""
    if (path := getattr(df, "_staged", None)) is not None:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, m: int):
    """crc32(column as text) mod m; a null counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % m).cast("int")


def word_blocks(text: str | None, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, A-Z lower-cased, in lists from pieces of about `size` bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= size:
        if words := data.split():
            yield words
        return
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        if words := data[at:end].split():
            yield words
        at = end


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name made from base that no frame has, whatever its spelling."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str = "text", size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive parts of about so many bytes of text, for work that holds every word of a part."""
    if not batch.num_rows:
        return
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def appended(df: DataFrame, new: str, make: Callable[[], Callable], reads: tuple[str, ...] = ("text",), drop: tuple[str, ...] = (), size: int = 2_000_000) -> DataFrame:
    """df with columns of the DDL `new`, worked out from lists of the columns `reads` (the first is the text), without the columns `drop`.

    make() gives a task its function from those lists to the lists of the new columns. All other columns pass through as Arrow
    arrays, so that neither nulls nor large integers change.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    fields = _parse_datatype_string(new).fields
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in {x.name for x in fields}]
    names, types = [f.name for f in kept], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for b in slices(whole, reads[0], size):
                out = work(*(column(b, r).to_pylist() for r in reads))
                yield pa.RecordBatch.from_arrays([*(column(b, n) for n in names), *(pa.array(x, t) for x, t in zip(out, types))], names=[*names, *(f.name for f in fields)])
        del work
        trim()

    return df.mapInArrow(run, StructType([*kept, *fields]))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, text, label) of at most `per_class` labelled documents a class outside the held-out fold, chosen by a hash of doc_id.

    Ids that carry both labels are left out; of rows that repeat an id, the least text stands for it.
    """
    lab = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod("doc_id", mod) != held))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).filter("label = _most").drop("_most")
    )
    order = [F.xxhash64("doc_id", F.lit(label)), F.col("doc_id")]
    picked = lab.filter("label = 1").orderBy(*order).limit(per_class).unionByName(lab.filter("label = 0").orderBy(*order).limit(per_class))
    rows = [(r[0], r[1]) for r in picked.collect()]  # 2 * per_class ids at most
    ids = documents.sparkSession.createDataFrame(rows, "doc_id long, label int")
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph given as (a, b): root is the least node that can be reached.

    Alternating large-star and small-star steps over aggregated minima: no neighbour list is ever built, and every round is
    written to the shared folder. Nodes without an edge don't appear.
    """

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every greater neighbour of u is linked to the least of u's neighbourhood
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # small star: every lesser neighbour of u, and u itself, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = staged(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_staged(large)
        drop_staged(now)
        now, after = small, mark(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def local_roots(n: int, a, b):
    """The least index that each of n nodes can reach over edges a[i] - b[i]; hooks and shortens until nothing changes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
