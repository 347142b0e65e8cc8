"""Change hints as streams (S-1 to S-8)."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import predicates as P
from loomgraph.sources.bundle import Bundle

REASONS = ["filesystem", "git_state", "queue_overflow"]


def classify_events(events: DataFrame, path: str = "path") -> DataFrame:
    """S-4: events with ``event_class``: ignored, git_state, project_control, source or other."""
    p = F.col(path)
    base = F.substring_index(p, "/", -1)
    return events.withColumn(
        "event_class",
        F.when(p.rlike(r"(^|/)\.git/(HEAD|index|refs/)"), F.lit("git_state"))
        .when(P.is_excluded_path(path) | P.is_generated(path) | p.rlike(r"(^|/)\.git/"), F.lit("ignored"))
        .when(base.isin("Cargo.toml", "Cargo.lock", "pyproject.toml", "go.mod", "go.sum", "package.json", "tsconfig.json"), F.lit("project_control"))
        .when(P.language(path).isNotNull(), F.lit("source"))
        .otherwise(F.lit("other")),
    )


def reason_rank(reason: Column | str) -> Column:
    """S-3: overflow outranks git state, which outranks the file system."""
    r = F.col(reason) if isinstance(reason, str) else reason
    return F.when(r == "queue_overflow", 2).when(r == "git_state", 1).otherwise(0)


def debounce(events: DataFrame, quiet: str = "75 milliseconds", most: int = 256, keys: list[str] | None = None, late: str | None = None) -> DataFrame:
    """S-1 to S-3: batches of events (ts, path, reason) that no ``quiet`` gap parts: first and last time, sorted distinct paths, reason.

    A batch of more than ``most`` paths keeps none: its reason is queue_overflow and it means "rescan everything". On a
    stream, ``late`` is the watermark; hints that come later are dropped by Spark, unlike in a watcher, which never drops one,
    so a periodic full reconciliation has to follow. ``keys``,
    such as the watched root, make independent batches that run in parallel. Works on static tables alike.
    """
    src = events.withWatermark("ts", late) if late else events
    #: A stream of sessions needs a key; without one all hints share an empty one, which is one task's work by nature.
    own = keys or ["__all"]
    src = src if keys else src.withColumn("__all", F.substring("path", 1, 0))
    batch = F.session_window("ts", quiet)
    grouped = src.groupBy(batch.alias("w"), *own).agg(F.collect_set("path").alias("set"), F.max(reason_rank("reason")).alias("rank"), F.count(F.lit(1)).alias("hints"))
    over = F.size("set") > most
    reason = F.get(F.array(*[F.lit(r) for r in REASONS]), F.when(over, F.lit(2)).otherwise(F.col("rank")))
    return grouped.select(
        *(keys or []), F.col("w.start").alias("first_ts"), F.col("w.end").alias("flush_ts"), F.when(over, F.array().cast("array<string>")).otherwise(F.sort_array("set")).alias("paths"), reason.alias("reason"), "hints"
    )


@dataclass
class Schedule:
    """S-5: which index run may start. Epochs count requests; a run covers the epoch desired at its start.

    A change supersedes a running change-driven run; a manual request pre-empts any run, and only one may wait; an epoch that
    failed is not tried again until a newer request. Methods return actions: ("start", id, trigger, epoch), ("cancel", id, reason).
    """

    desired: int = 0
    published: int = 0
    failed: int = 0
    next_id: int = 0
    active: dict | None = None
    manual: int | None = None
    watching: bool = False
    done: list[int] = field(default_factory=list)
    #: Held while a stream drives the schedule, as hints and reconciliations come from different threads.
    lock: threading.RLock = field(default_factory=threading.RLock, repr=False, compare=False)

    def _id(self) -> int:
        self.next_id += 1
        return self.next_id

    def _cancel(self, reason: str) -> list[tuple]:
        if not self.active or self.active.get("cancelled"):
            return []
        self.active["cancelled"] = reason
        return [("cancel", self.active["id"], reason)]

    def _next(self) -> list[tuple]:
        if self.active:
            return []
        if self.manual is not None:
            run, self.manual = {"id": self.manual, "trigger": "manual"}, None
        elif self.watching and self.desired > max(self.published, self.failed):
            run = {"id": self._id(), "trigger": "watch", "change": True}
        else:
            return []
        self.active = run | {"epoch": self.desired}
        return [("start", run["id"], run["trigger"], self.desired)]

    def watch(self) -> list[tuple]:
        self.watching = True
        return self._next()

    def change(self, supersede: bool = True) -> list[tuple]:
        """A hint (``supersede``) or a periodic reconciliation."""
        self.desired += 1
        if self.active:
            return self._cancel("superseded") if supersede and self.active.get("change") else []
        return self._next()

    def request(self) -> list[tuple]:
        if self.manual is not None or (self.active and self.active["trigger"] == "manual"):
            return [("busy",)]
        self.manual = self._id()
        return self._cancel("manual_priority") if self.active else self._next()

    def finish(self, run: int, result: str) -> list[tuple]:
        """``result`` is published, failed or cancelled."""
        if not self.active or self.active["id"] != run:
            return [("not_active", run)]
        epoch, self.active = self.active["epoch"], None
        if result == "published":
            self.published = max(self.published, epoch)
            self.failed = 0 if self.failed <= self.published else self.failed
        elif result == "failed":
            self.failed = max(self.failed, epoch)
        self.done.append(run)
        return self._next()


def _drive(schedule: Schedule, run: Callable[[int, str, int], str], supersede: bool) -> Callable[[DataFrame, int], None]:
    def step(df: DataFrame, _: int) -> None:
        if not df.take(1):
            return
        with schedule.lock:
            actions = schedule.change(supersede)
            while actions:
                kind, *rest = actions[0]
                actions = schedule.finish(rest[0], run(*rest)) if kind == "start" else actions[1:]

    return step


def scheduled(batches: DataFrame, schedule: Schedule, run: Callable[[int, str, int], str], checkpoint: str, trigger: str = "1 second"):
    """S-5, S-6: drive a schedule from a stream of debounced batches: each micro-batch with rows is one change; the trigger is the probe.

    ``run`` (id, trigger, epoch) indexes and returns published, failed or cancelled.
    """
    return batches.writeStream.foreachBatch(_drive(schedule, run, True)).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def reconciled(spark: SparkSession, schedule: Schedule, run: Callable[[int, str, int], str], checkpoint: str, every: str = "60 seconds"):
    """S-6: a full check ``every`` so often, beside :func:`scheduled` on the same schedule: it finds what dropped hints missed and supersedes no run."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(_drive(schedule, run, False)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def refresh_plan(documents: DataFrame) -> DataFrame:
    """S-7: one row (plan, reason, affected) from documents (path, before, after, surface_before, surface_after, inputs_changed, identity_changed).

    Nothing changed: exact_reuse. A document added or deleted, a changed surface, input or identity: full certification, with
    the first reason in this order. Else only the changed documents are affected.
    """
    facts = documents.agg(
        F.bool_or(F.col("before").isNull()).alias("add"), F.bool_or(F.col("after").isNull()).alias("delete"),
        F.bool_or(~F.col("surface_before").eqNullSafe(F.col("surface_after")) & F.col("before").isNotNull() & F.col("after").isNotNull()).alias("surface"),
        F.bool_or("inputs_changed").alias("inputs"), F.bool_or("identity_changed").alias("identity"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("affected"),
    )
    reason = F.when(F.col("add"), F.lit("document_added")).when(F.col("delete"), F.lit("document_deleted")).when(F.col("surface"), F.lit("surface_changed")).when(F.col("inputs"), F.lit("input_changed")).when(F.col("identity"), F.lit("identity_changed"))
    plan = F.when(reason.isNotNull(), F.lit("certify_full")).when(F.col("affected") > 0, F.lit("refresh_affected")).otherwise(F.lit("exact_reuse"))
    return facts.select(plan.alias("plan"), reason.alias("reason"), "affected")


def merge_generation(bundle: Bundle, changed: DataFrame, deleted: DataFrame, table: str = "symbols", **publish: object) -> str:
    """S-8: a new generation whose rows of unchanged files are carried over and of changed files replaced; readers see it at once or not at all."""
    old = bundle.open(table)
    touched = changed.select("file_path").union(deleted.select("file_path")).distinct()
    kept = old.join(touched, "file_path", "left_anti").select(old.columns)
    return bundle.publish({table: kept.unionByName(changed.select(old.columns))}, **publish)
