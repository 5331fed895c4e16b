"""The stream of document changes.

Every function takes a batch or a streaming DataFrame unless its name says otherwise.
Changes are ``(ts, kind, path, dest_path)`` and may have further columns; paths are
relative to the root. Normalised changes are ``(ts, action, path)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from kinshelf.config import Settings
from kinshelf.functions.paths import is_excluded, is_supported
from kinshelf.operators.catalog import catalog_diff, delete, incremental_analyze, scan_changes, upsert
from kinshelf.session import cut_lineage


def normalize_changes(changes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Changes as "changed" and "deleted" paths.

    A delete counts for any file type. A move deletes its source and changes its
    destination. Hidden and build directories are left out by the source path.
    """
    path, dest, kind = F.col("path"), F.col("dest_path"), F.col("kind")

    def event(action: str, where: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(action).alias("action"), where.alias("path")))

    events = F.array_compact(
        F.array(
            event("deleted", path, kind.isin("deleted", "moved")),
            event("changed", dest, (kind == "moved") & is_supported(dest)),
            event("changed", path, kind.isin("created", "modified") & is_supported(path)),
        )
    )
    return (
        changes.where(~is_excluded(path))
        .select("ts", *(keep or []), F.explode(events).alias("_event"))
        .select("ts", *(keep or []), "_event.action", "_event.path")
    )


def suppress_own_changes(changes: DataFrame, own_paths: DataFrame) -> DataFrame:
    """Without the changes the organiser made itself: ``own_paths(path)``."""
    return changes.join(own_paths.select("path"), "path", "left_anti")


def outside_intervals(changes: DataFrame, intervals: DataFrame, slot_seconds: int = 60) -> DataFrame:
    """Changes not within any of ``intervals(start, end)``, the end excluded.

    Both sides meet by time slot, so this is an equi-join and works for a stream
    against a table.
    """
    slot = F.floor(F.unix_micros("ts") / (slot_seconds * 1_000_000))
    slots = intervals.where(F.col("end") > F.col("start")).select(
        "start",
        "end",
        F.explode(
            F.sequence(
                F.floor(F.unix_micros("start") / (slot_seconds * 1_000_000)),
                F.floor(F.unix_micros("end") / (slot_seconds * 1_000_000)),
            )
        ).alias("_slot"),
    )
    left, right = changes.withColumn("_slot", slot).alias("c"), slots.alias("i")
    inside = (
        (F.col("c._slot") == F.col("i._slot"))
        & (F.col("c.ts") >= F.col("i.start"))
        & (F.col("c.ts") < F.col("i.end"))
    )
    return left.join(right, inside, "left_anti").drop("_slot")


def while_running(changes: DataFrame, pauses: DataFrame) -> DataFrame:
    """Changes that did not happen in a pause: ``pauses(start, end)``."""
    return outside_intervals(changes, pauses)


def cooldown(changes: DataFrame, syncs: DataFrame, seconds: int = 3) -> DataFrame:
    """Without what happened within ``seconds`` after a sync: ``syncs(sync_ts)``."""
    spans = syncs.select(
        F.col("sync_ts").alias("start"),
        (F.col("sync_ts") + F.make_dt_interval(secs=F.lit(seconds))).alias("end"),
    )
    return outside_intervals(changes, spans)


def debounce(changes: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """Stream of batches: changes until ``seconds`` without one, per ``by``.

    ``(started, ended, changed, deleted)``, each path once per kind. ``by`` names the
    root, or also the top folder where one root is too busy for one task. Rows later
    than the watermark are dropped; the reconcile run finds what they told, except
    for edits.
    """
    window = F.session_window("ts", f"{seconds} seconds")

    def paths(action: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("action") == action, F.col("path"))))

    return (
        changes.withWatermark("ts", f"{seconds} seconds")
        .groupBy(window.alias("window"), *by)
        .agg(paths("changed").alias("changed"), paths("deleted").alias("deleted"))
        .select(
            *by,
            F.col("window.start").alias("started"),
            F.col("window.end").alias("ended"),
            "changed",
            "deleted",
        )
    )


class _Burst(StatefulProcessor):
    """Changes of one key that wait until ``seconds`` have passed without another one."""

    ROWS = 10_000

    def __init__(self, by: list[str], seconds: int) -> None:
        self.by, self.millis = by, seconds * 1000

    def init(self, handle) -> None:
        # one entry per path and action, so no row of the state holds a burst
        self.waiting = handle.getMapState("waiting", "action string, path string", "ts timestamp")
        self.times = handle.getValueState("times", "started long, ended long, timer long")
        self.handle = handle

    def _told(self, key) -> Iterator[pd.DataFrame]:
        """The waiting changes, in parts; the state is empty afterwards."""
        started, ended, timer = self.times.get()
        times = {"started": pd.to_datetime(started, unit="ms"), "ended": pd.to_datetime(ended, unit="ms")}
        rows = []

        def part() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["action", "path", "ts"])
            return frame.assign(**times, **dict(zip(self.by, key)))[[*self.by, *times, "ts", "action", "path"]]

        for (action, path), (ts,) in self.waiting.iterator():
            rows.append((action, path, ts))
            if len(rows) == self.ROWS:
                yield part()
                rows = []
        if rows:
            yield part()
        self.waiting.clear()
        self.times.clear()
        self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.times.exists() and self.times.get()[2] <= now:
            yield from self._told(key)  # its time was up before these came
        started = now
        if self.times.exists():
            started, _, timer = self.times.get()
            self.handle.deleteTimer(timer)
        for frame in rows:
            for action, path, ts in zip(frame["action"], frame["path"], frame["ts"]):
                self.waiting.updateValue((action, path), (ts,))
        self.times.update((started, now, now + self.millis))
        self.handle.registerTimer(now + self.millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.times.exists() and self.times.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            yield from self._told(key)

    def close(self) -> None:
        pass


#: State stores that keep timers and maps.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def debounce_arrivals(changes: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """Stream of changes, held back until none has arrived for ``seconds``, per ``by``.

    ``(*by, started, ended, ts, action, path)``: a row per path and action of a burst with
    the time the last such change says, and the times between which the burst arrived.
    The clock is that of the stream, so no change is too late, and the last burst ends
    without a later one. What was told leaves the state. ``by`` names the root, or also
    the top folder where one root is too busy for one task. The stream needs the RocksDB
    state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    return (
        changes.select(*by, "ts", "action", "path")
        .groupBy(*by)
        .transformWithStateInPandas(
            statefulProcessor=_Burst(by, seconds),
            outputStructType=f"{keys}, started timestamp, ended timestamp, ts timestamp, action string, path string",
            outputMode="append",
            timeMode="processingTime",
        )
    )


def debounce_batch(changes: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """``debounce`` for a table: every change with the ``session`` it belongs to.

    ``session`` is the time of its first change. Changes are first gathered in time
    slots as long as the gap; those of one slot always belong together. So only one
    row per slot is put in order, however many changes a root has.
    """
    micros = seconds * 1_000_000
    at = F.unix_micros("ts")
    slotted = changes.withColumn("_slot", F.floor(at / micros))
    slots = slotted.groupBy(*by, "_slot").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    ordered = Window.partitionBy(*by).orderBy("_slot")
    gap = F.unix_micros("_from") - F.unix_micros(F.lag("_to").over(ordered))
    begins = F.when(F.coalesce(gap > micros, F.lit(True)), F.col("_from"))
    sessions = slots.withColumn("_begins", begins).withColumn(
        "session", F.last("_begins", ignorenulls=True).over(ordered)
    )
    return slotted.join(sessions.select(*by, "_slot", "session"), [*by, "_slot"]).drop("_slot")


def apply_changes(
    files: DataFrame, batch: DataFrame, describe: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Catalog after one batch ``(action, path)``.

    ``describe`` turns ``(file_path)`` into described documents with an ``embedding``
    column, leaving out paths it cannot read; their rows stay. Deletions come after
    changes, so a path in both ends deleted.
    """
    changed = batch.where(F.col("action") == "changed").select(F.col("path").alias("file_path"))
    deleted = batch.where(F.col("action") == "deleted").select(F.col("path").alias("file_path"))
    _, renewed = incremental_analyze(files, describe(changed.distinct()))
    known = [c for c in renewed.columns if c in files.columns]
    return delete(upsert(files, renewed.select(known), "file_path"), deleted, "file_path")


def reconcile(
    files: DataFrame,
    scan: DataFrame,
    describe: Callable[[DataFrame], DataFrame],
    apply: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """Catalog after comparing it with a scan, or None if nothing is new, gone or edited.

    Where the scan has sizes and times, as ``list_files`` gives them, edits are found by
    them, and only folders that differ are looked into. ``apply`` takes the batch
    ``(action, path)`` in place of ``apply_changes``.
    """
    timed = {"file_size", "modification_date"} <= {*scan.columns} & {*files.columns}
    diff = cut_lineage(scan_changes(files, scan) if timed else catalog_diff(files, scan))
    if diff.isEmpty():
        return None
    action = F.when(F.col("status") == "removed", "deleted").otherwise("changed")
    batch = diff.select(action.alias("action"), F.col("file_path").alias("path"))
    return apply(batch) if apply else apply_changes(files, batch, describe)


def follow_changes(
    changes: DataFrame,
    checkpoint: str,
    apply: Callable[[DataFrame, int], None],
    settings: Settings = Settings(),
    available_now: bool = False,
    heartbeat: bool = False,
    own_paths: DataFrame | None = None,
    pauses: DataFrame | None = None,
    syncs: DataFrame | None = None,
    by_arrival: bool = False,
) -> StreamingQuery:
    """Run ``apply(batch, batch_id)`` for the debounced stream of raw changes.

    The changes have a ``root`` column; a batch has ``(root, action, path)``.
    Spark may repeat a batch after a failure, so ``apply`` should write the snapshot
    of ``batch_id`` and overwrite an unfinished one.

    Changes of ``own_paths(path)``, within ``pauses(start, end)`` or shortly after
    ``syncs(sync_ts)`` are left out. With ``by_arrival`` a burst ends when no change has
    arrived for the quiet time, by the clock of the stream; nothing is too late and a
    session's paths are rows of their own. Otherwise the times of the changes count, and a
    burst ends when a later event says that time has passed. With ``heartbeat`` a clock does,
    once a second, so that the last burst is applied after its quiet time as well; the times
    of changes have to be the clock's.
    """

    def each(sessions: DataFrame, batch_id: int) -> None:
        if by_arrival:
            rows = sessions.select("root", "action", "path").distinct()
        else:
            kinds = [("changed", "changed"), ("deleted", "deleted")]
            rows = None
            for column, action in kinds:
                part = sessions.select(
                    "root", F.lit(action).alias("action"), F.explode(column).alias("path")
                ).distinct()
                rows = part if rows is None else rows.unionByName(part)
        rows = rows.persist()  # else the state is run through once for every use
        try:
            if not rows.isEmpty():
                apply(rows, batch_id)
        finally:
            rows.unpersist()

    if own_paths is not None:
        changes = suppress_own_changes(changes, own_paths)
    if pauses is not None:
        changes = while_running(changes, pauses)
    if syncs is not None:
        changes = cooldown(changes, syncs, settings.sync_cooldown_seconds)
    events = normalize_changes(changes, ["root"])
    if by_arrival:
        changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        batches = debounce_arrivals(events, settings.debounce_seconds, ["root"])
    else:
        if heartbeat:
            clock = changes.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
            beats = clock.select(F.col("timestamp").alias("ts"), F.lit("beat").alias("action"))
            events = events.unionByName(beats, allowMissingColumns=True)
        batches = debounce(events, settings.debounce_seconds, ["root"])
    writer = batches.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(each)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def every_few_seconds(
    spark: SparkSession, run: Callable[[], None], checkpoint: str, settings: Settings = Settings()
) -> StreamingQuery:
    """Call ``run``, such as a reconcile pass, in a fixed rhythm."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        clock.writeStream.foreachBatch(lambda _, __: run())
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{settings.reconcile_seconds} seconds")
        .start()
    )
