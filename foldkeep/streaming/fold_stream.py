"""The fold over a stream: a base that is rewritten now and then, and a tail of the rows that came since.

A micro-batch only appends its rows to the tail, so its cost is its own size and
not the state's. Reading the state merges the tail's deltas over the base; after
``every`` batches that merge becomes the new base. Exactly once by idempotence:
a batch is there once its number is named, and a repeated one finds it named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldkeep.operators.compact import deltas
from foldkeep.operators.merge import merge
from foldkeep.schema import ELEMENT, LOG, META
from foldkeep.session import materialize


class FoldStream:
    """State under ``path``, brought forward by ``start`` and read by ``state``."""

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path, every

    def _fs(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, name: str) -> list[int]:
        """The numbers named in a folder of empty files, in order."""
        p, fs = self._fs(name)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _name(self, name: str, number: int) -> None:
        p, fs = self._fs(f"{name}/{number}")
        fs.create(p, True).close()

    def version(self) -> int:
        """The number of the last batch that is absorbed as a whole (-1: none)."""
        return max(self._named("done"), default=-1)

    def _base(self) -> tuple[int, DataFrame, DataFrame]:
        v = max(self._named("bases"), default=-1)
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/base-{v}/{name}") if v >= 0 else self.spark.createDataFrame([], schema)
        return v, read("element", ELEMENT), read("meta", META)

    def tail(self) -> list[int]:
        """Batches that the base doesn't hold yet."""
        v = max(self._named("bases"), default=-1)
        return [n for n in self._named("done") if n > v]

    def state(self) -> tuple[DataFrame, DataFrame]:
        """``(element, meta)`` after all absorbed batches."""
        _, element, meta = self._base()
        tail = self.tail()
        if not tail:
            return element, meta
        rows = self.spark.read.schema(LOG).parquet(*[f"{self.path}/tail-{n}" for n in tail])
        # a flush in the tail wipes its shard's base; the table of floors has a row a shard at most
        flushed = rows.where("op = 'FLUSH'").select("shard").distinct()
        element, meta = (t.join(F.broadcast(flushed), "shard", "left_anti").select(t.columns) for t in (element, meta))
        element, meta = merge(element, meta, materialize(deltas(rows), "stream-delta"))
        placed = lambda t, schema: t.select(*[c.split()[0] for c in schema.split(", ")])
        return placed(element, ELEMENT), placed(meta, META)

    def rebase(self) -> None:
        """Write the state as the new base, and drop what it replaces."""
        done, tail = self.version(), self.tail()
        if not tail:
            return
        old, _, _ = self._base()
        element, meta = self.state()
        element.write.mode("overwrite").parquet(f"{self.path}/base-{done}/element")
        meta.write.mode("overwrite").parquet(f"{self.path}/base-{done}/meta")
        self._name("bases", done)
        for name in [*[f"tail-{n}" for n in tail], *([f"base-{old}"] if old >= 0 else [])]:
            p, fs = self._fs(name)
            fs.delete(p, True)

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Take in one batch of log rows (``foreachBatch``)."""
        if number <= self.version():
            return
        batch.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/tail-{number}")
        self._name("done", number)
        if len(self.tail()) >= self.every:
            self.rebase()

    def start(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a streaming log (schema ``LOG``)."""
        return log.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def log_source(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A log folder as a stream, so many files a batch."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).parquet(path)
