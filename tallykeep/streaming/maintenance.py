"""A maintained aggregate behind a Structured Streaming query: transactions, certificates, repairs, latch and rebuild.

Every micro-batch writes one version of the group state to a shared folder, from the version before; a batch that
runs again after a failure writes the same version again. So the state survives lost executors and restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.certify import certify
from ..operators.maintain import deltas, merge, overflowed
from ..plans.shapes import QueryShape, cold_state
from .transactions import assemble_stream

#: Versions of the state that stay, the last one included.
KEPT = 2


class StateFolder:
    """Versions of one shape's group state, as <path>/state/<number>-ok or -latched, of Parquet files.

    A latched version says that the state isn't right any more: nothing is repaired until rebuild() is called.
    """

    def __init__(self, spark: SparkSession, path: str, shape: QueryShape):
        self.spark, self.path, self.shape = spark, path.rstrip("/"), shape

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[tuple[int, bool]]:
        """Complete versions (number, latched), in order."""
        fs, path = self._folder()
        if not fs.exists(path):
            return []
        jvm = self.spark._jvm.org.apache.hadoop.fs
        names = [f.getPath() for f in fs.listStatus(path)]
        done = [p.getName() for p in names if fs.exists(jvm.Path(p, "_SUCCESS"))]
        return sorted((int(n.split("-")[0]), n.endswith("-latched")) for n in done)

    def _name(self, version: tuple[int, bool]) -> str:
        return f"{self.path}/state/{version[0]}-{'latched' if version[1] else 'ok'}"

    def seed(self, rows: DataFrame) -> None:
        """Start from the table's rows."""
        self.write(cold_state(self.shape, rows), 0, False)

    def read(self, before: int | None = None) -> tuple[DataFrame, bool]:
        """The last version (before a number), and whether it is latched."""
        have = [v for v in self.versions() if before is None or v[0] < before]
        if not have:
            raise ValueError("the state has to be seeded first")
        return self.spark.read.parquet(self._name(have[-1])), have[-1][1]

    def write(self, state: DataFrame, number: int, latched: bool) -> None:
        state.write.mode("overwrite").parquet(self._name((number, latched)))
        fs, _ = self._folder()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs.delete(path(self._name((number, not latched))), True)  # of a run of the same batch that failed
        for v in self.versions()[:-KEPT]:
            fs.delete(path(self._name(v)), True)

    def rebuild(self, rows: DataFrame) -> None:
        """Recompute a latched state from the table's rows as they are now, and let repairs go on."""
        self.write(cold_state(self.shape, rows), self.versions()[-1][0], False)

    def certificates(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/certificates")


def _batch(folder: StateFolder, rebuild: Callable[[SparkSession, int], DataFrame] | None):
    def run(batch: DataFrame, batch_id: int) -> None:
        shape, number = folder.shape, batch_id + 1
        state, latched = folder.read(number)
        fitted = shape.fitted(state)
        batch = batch.persist()
        own = batch.where("decision is not null").select("stream_id", "seq", "event_id", "decision", "reason")
        certified = certify(batch.where("decision is null"), fitted)
        every = own.unionByName(certified.select("stream_id", "seq", "event_id", "decision", "reason"))
        first = every.where(F.col("decision").isin("invalidate", "unsupported")).agg(F.min("seq")).first()[0]
        if latched or first is not None:
            late = F.lit(True) if latched else F.col("seq") > F.lit(first)
            late = late & (F.col("decision") == "repair")
            every = every.withColumns({"decision": F.when(late, "invalidate").otherwise(F.col("decision")), "reason": F.when(late, "cache_requires_rebuild").otherwise(F.col("reason"))})
        every.write.mode("overwrite").parquet(f"{folder.path}/certificates/batch={batch_id}")
        new = state if latched or first is not None else merge(fitted, state, deltas(certified, fitted))
        bad = latched or first is not None or not overflowed(new).isEmpty()
        if bad and rebuild is not None:
            last = batch.agg(F.max("seq")).first()[0]
            folder.write(cold_state(shape, rebuild(folder.spark, -1 if last is None else last)), number, False)
        else:
            folder.write(state if bad else new, number, bad)
        batch.unpersist()

    return run


def maintain_stream(records: DataFrame, folder: StateFolder, checkpoint: str, rebuild: Callable[[SparkSession, int], DataFrame] | None = None, strict: bool = False, **trigger) -> StreamingQuery:
    """Keep the folder's state right under a stream of decoded records; trigger as for writeStream.

    Transactions are assembled first. A batch in which every change is certified merges its deltas into the
    state. One that invalidates latches it: rebuild(spark, seq), if given, returns the table's rows as they are
    after all changes up to seq, from which the state is recomputed at once; without it later repairs turn into
    cache_requires_rebuild until the folder's rebuild() is called. A record of kind FINISH ends a stream: what
    its open transaction holds is discarded. No records, no change.
    """
    released = assemble_stream(records, strict)
    writer = released.writeStream.foreachBatch(_batch(folder, rebuild)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
