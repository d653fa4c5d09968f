"""Rallies from a growing trajectory, published once each.

A stateful operator keeps each video's open segment (``segments.py``); what a
batch closes is analysed and appended, so a batch costs what it brings. A gap is
judged when all frames that its rules look ahead at are there, so what is
published never changes. The open segments of a stream that has ended are read
from its state.

Rallies are folders by batch number, written over if a batch runs again. The
checkpoint counts batches on; without it stored rallies belong to another run, and
the stream refuses to start.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

from ..operators.hits import rallies_of
from ..params import DEFAULTS, RallyParameters
from .segments import CLOSED, SCAN, closed_segments, decide, limits, names

#: What is stored of a rally; its number follows from the order of a video's rallies.
RALLIES = (
    "video_id long, start_frame long, end_frame long, start_seconds double, end_seconds double, hit_count long, observed_hits long, inferred_gap_hits long"
)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StreamingQueryListener):
    """What a stream has taken so far: a row a batch, of the latest batches."""

    #: Batches whose rows are held.
    most = 1000

    def __init__(self, name: str):
        self.name, self.rows = name, []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name and p.numInputRows:
            state = p.stateOperators[0] if p.stateOperators else None
            self.rows = [*self.rows, (p.batchId, p.numInputRows, state.numRowsTotal if state else 0, p.batchDuration)][-self.most :]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


class RallyStream:
    """A running analysis: state and published rallies under one shared folder."""

    def __init__(self, spark: SparkSession, root: str, videos: DataFrame, p: RallyParameters = DEFAULTS):
        self.spark, self.root, self.videos, self.p = spark, root, videos, p
        self.published = 0

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _publish(self, segments: DataFrame, table: str) -> None:
        known = self.videos.where("fps > 0")
        rallies_of(segments, known, self.p).select(*names(RALLIES)).write.mode("overwrite").parquet(f"{self.root}/{table}")

    def process(self, segments: DataFrame, batch: int) -> None:
        """Analyse the segments that a batch closed, and append their rallies."""
        self._publish(segments, f"rallies/batch={batch}")
        self.published += self.spark.read.schema(RALLIES).parquet(f"{self.root}/rallies/batch={batch}").count()

    def run(self, frames: DataFrame, cancelled: Callable[[], bool] = lambda: False, most: int | None = None) -> list[tuple]:
        """Take all that a streaming DataFrame of frames has now; returns a row for each batch taken.

        A row: batch, frames taken, rows in the state, milliseconds. ``cancelled``
        is asked before every batch, and once it says yes the stream stops; so it
        does behind the batch with which it has published ``most`` rallies. Batches
        that were taken are kept, and the next run goes on behind them.
        """
        if self._exists("rallies") and not self._exists("checkpoint"):
            raise ValueError(f"{self.root} holds rallies of another run: their checkpoint is gone")
        path, files = self._path("last")
        files.delete(path, True)  # the last rallies of a stream that goes on are not its last
        self.published = 0
        name = f"rallies-{uuid.uuid4().hex}"
        progress = Progress(name)
        enough = lambda: most is not None and self.published >= most
        stopped: list[int] = []

        def take(rows: DataFrame, batch: int) -> None:
            if enough() or cancelled():
                stopped.append(batch)
                raise InterruptedError("stopped")  # the batch is not taken, and comes again with the next run
            self.process(rows, batch)

        config = {"spark.sql.streaming.stateStore.providerClass": STORE}
        before = {k: self.spark.conf.get(k, None) for k in config}
        for k, v in config.items():
            self.spark.conf.set(k, v)
        self.spark.streams.addListener(progress)
        try:
            query = (
                closed_segments(frames, self.videos, self.p)
                .writeStream.queryName(name)
                .foreachBatch(take)
                .option("checkpointLocation", f"{self.root}/checkpoint")
                .trigger(availableNow=True)
                .start()
            )
            query.awaitTermination()  # a stream stops between batches only: what runs is never cut off while it writes
        except StreamingQueryException:
            if not stopped:
                raise
        finally:
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            self.spark.streams.removeListener(progress)
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return progress.rows

    def _state(self, name: str) -> DataFrame:
        reader = self.spark.read.format("statestore").option("path", f"{self.root}/checkpoint").option("stateVarName", name)
        return reader.load()

    def open_segments(self) -> DataFrame:
        """Rows of the segments that no gap has closed, cut at the gaps that end here, from the state."""
        scan = self._state("scan").select(F.col("key.video_id").alias("video_id"), "value.*").join(limits(self.videos, self.p), "video_id")

        def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                cuts = [decide(*(np.asarray(r[c], k) for c, k in (("pos", np.int64), ("frame", np.int64), ("x", float), ("y", float))), r, 1 << 62, r["settled"])[0] for r in part.to_dict("records")]
                yield pd.DataFrame({"video_id": part["video_id"], "segment": part["segment"], "cuts": cuts})

        known = scan.select("video_id", *names(SCAN), "restart", "split", "long", "behind", "ahead", "diag", "top").mapInPandas(judge, "video_id long, segment long, cuts array<long>")
        rows = self._state("open").select(F.col("key.video_id").alias("video_id"), "list_element.*").join(known, "video_id")
        rows = rows.withColumn("segment_id", F.col("segment") + F.size(F.filter("cuts", lambda c: c < F.col("pos"))))
        whole = Window.partitionBy("video_id", "segment_id")
        shown = F.when(F.col("visible"), F.col("pos"))
        rows = rows.withColumn("_first", F.min(shown).over(whole)).withColumn("_last", F.max(shown).over(whole))
        return rows.where("pos between _first and _last").select(*names(CLOSED))

    def rallies(self) -> DataFrame:
        """All that is published, numbered by video."""
        parts = [self.spark.read.schema(RALLIES).parquet(f"{self.root}/{t}") for t in ("rallies", "last") if self._exists(t)]
        stored = reduce(DataFrame.unionByName, (p.select(*names(RALLIES)) for p in parts)) if parts else self.spark.createDataFrame([], RALLIES)
        return stored.withColumn("rally", F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame")).cast("long"))

    def finish(self) -> DataFrame:
        """Publish the rallies of open segments too, and return all.

        Nothing stored is changed; a later ``run`` takes these last ones back. A
        stream that has not run has none.
        """
        if self._exists("checkpoint/state/0"):
            self._publish(self.open_segments(), "last")
        return self.rallies()
