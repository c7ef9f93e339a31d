"""Tables in the folder that driver and executors share, and connected components over them."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir


#: Contracted edges that one task labels (16 MB); more take rounds over all partitions.
ONE_TASK = 1_000_000


def lean(run: Callable) -> Callable:
    """A function over batches that gives its freed memory back to the system at the end of each partition; Python workers
    live on, and what one holds idle is missing for the others."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def free(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later jobs don't repeat it, and a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/tallyloom-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def erase(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a partition, as edges from each node to the smallest of its component in that partition."""
    us, vs = [], []
    for b in batches:
        us.append(b.column(0).to_numpy(zero_copy_only=False))
        vs.append(b.column(1).to_numpy(zero_copy_only=False))
    if not us:
        return
    u, v = np.concatenate(us), np.concatenate(vs)
    nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = index[: len(u)], index[len(u) :], np.arange(len(nodes))
    while True:  # nodes are sorted, so the smallest index is the smallest node
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    far = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far], pa.int64()), pa.array(nodes[root[far]], pa.int64())], names=["u", "v"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all edges with the smallest of its component."""
    for b in _contract(batches):
        u, v = (b.column(i).to_numpy() for i in (0, 1))
        least = np.unique(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, least])), pa.array(np.concatenate([v, least]))], names=["node", "component"])


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of ``edges`` (u long, v long) reaches.

    Edges are first contracted within partitions. Up to ONE_TASK are then labelled in one task. Of more, each round gives a node the smallest label among its own, its
    neighbours' and that label's own label, until nothing changes; each round's labels are written to the shared folder."""
    e = written(edges.filter("u <> v").mapInArrow(lean(_contract), "u long, v long"), "edges")
    if e.count() <= ONE_TASK:
        labels = written(e.coalesce(1).mapInArrow(lean(_labels), "node long, component long"), "labels")
        erase(e)
        return labels
    both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "both")
    labels = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("l").alias("near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("l").alias("old"), F.least("l", "near").alias("l"))
        ahead = labels.select(F.col("node").alias("l"), F.col("l").alias("ahead"))
        new = written(step.join(ahead, "l").select("node", "old", F.least("l", "ahead").alias("l")), "labels")
        erase(labels)
        labels = new
        if new.filter("old <> l").limit(1).count() == 0:
            erase(e, both)
            return labels.select("node", F.col("l").alias("component"))
