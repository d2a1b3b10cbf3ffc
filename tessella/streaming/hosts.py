"""Hosts for steps: replay of a table, and a live stream; both for steps with a clock, too.

A step is made anew for each key by its factory, takes rows in order and returns output rows:
``step(row: dict) -> list[dict]``.  Its state is what it holds; ``dump`` and ``load`` carry it between
micro-batches.  Rows of a key are sorted by ``order`` in replay and inside each micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Step:
    """Base of all steps: the state is the instance's attributes."""

    def __call__(self, row: dict[str, Any]) -> list[dict[str, Any]]:
        raise NotImplementedError

    def finish(self) -> list[dict[str, Any]]:
        """What is left to say when the replayed table ends; streams do not end."""
        return []

    def dump(self) -> bytes:
        return pickle.dumps(self.__dict__)

    def load(self, state: bytes) -> Step:
        self.__dict__.update(pickle.loads(state))
        return self


class Timed(Step):
    """Base of steps with a clock (microseconds) and timers.

    ``tables`` names the attributes that hold state: dicts from a string to a tuple, each with the schemas
    of both.  ``due`` is the next moment at which something is to be done without a row, ``fire`` does it.
    A host fires what is due before it hands over a row of that time or later.
    """

    tables: dict[str, tuple[str, str]] = {}

    def __init__(self):
        self.clock: int | None = None

    def due(self) -> int | None:
        raise NotImplementedError

    def fire(self, now: int) -> list[dict[str, Any]]:
        raise NotImplementedError

    def until(self, now: int | None) -> list[dict[str, Any]]:
        """All that is due up to ``now`` (None: to the end), in order."""
        out = []
        while (due := self.due()) is not None and (now is None or due <= now):
            out += self.fire(due)
        return out


def _records(pdf: pd.DataFrame) -> Iterator[dict[str, Any]]:
    names = list(pdf.columns)
    for values in pdf.itertuples(index=False, name=None):
        yield {n: (None if v is pd.NaT or v is None or (isinstance(v, float) and v != v) else v) for n, v in zip(names, values, strict=True)}


def _frame(rows: list[dict[str, Any]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _dealt(rows: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with all rows of a key in one partition.

    By the key's hash, so that it is an exchange of its own: one by the key itself is left out where Spark
    takes the rows for dealt already, and what it took them for may change while the query runs.
    """
    return rows.repartition(parts, F.xxhash64(*key)) if parts else rows.repartition(F.xxhash64(*key))


def replay(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], Step], schema: str, parts: int | None = None) -> DataFrame:
    """Run a step over each key's rows in order; columns of the key that ``schema`` names are filled in.

    ``parts``: for few keys of much work each, so many partitions that hardly two keys fall together, which
    Spark then doesn't merge again either.

    Spark sorts a task's rows by key and order (on disk, where they are many) and they pass in Arrow
    batches, so a task holds one batch and one step's state, however long a key is.  A key's rows stay one
    task's time, as the recurrence demands; keep keys narrow (camera and day, say).
    """
    names = T.StructType.fromDDL(schema).fieldNames()
    told = [k for k in key if k in names]

    def owned(out: list[dict], at: tuple) -> list[dict]:
        owner = {k: v for k, v in zip(key, at, strict=True) if k in told}
        return [owner | r for r in out] if told else out

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, at = None, None
        for pdf in pdfs:
            out = []
            for row in _records(pdf):
                own = tuple(row[k] for k in key)
                if step is None or own != at:
                    out += owned(step.finish(), at) if step else []
                    step, at = make(), own
                out += owned(step(row), own)
            yield _frame(out, names)
        if step:
            yield _frame(owned(step.finish(), at), names)

    placed = _dealt(rows, key, parts).sortWithinPartitions(*key, *(F.col(c).asc_nulls_last() for c in order))
    return placed.mapInPandas(run, schema)


def chained(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], Step], schema: str, frames: int) -> tuple[DataFrame, DataFrame]:
    """Run a step over each key's rows in order, in stretches of ``frames`` rows that run at once; the result is that of one uncut run.

    All that goes from one stretch to the next is the step's state.  In the first round every stretch
    starts from nothing; in each further one the first of a key's stretches runs again that started from
    anything but its predecessor's end, until there is none.  Where a repaired stretch ends as it did
    before, all that follows stands as it is.  So a stretch runs twice at most, and a key takes one round
    more for each stretch that its state outlives.
    A step has begin(stretch), digest() of its state, and births, a number told for each stretch.

    Returns (the step's rows with the key and __stretch, what the stretches told: key, __stretch, births).
    """
    from tessella.operators.scan import numbered
    from tessella.session import cut_lineage

    names, kinds = T.StructType.fromDDL(schema).fieldNames(), dict(rows.dtypes)
    own = numbered(rows, key, order)
    own = cut_lineage(own.withColumn("__stretch", F.floor(F.col("__at") / frames)).drop("__at"))
    told = ["__stretch", "__state", "__digest", "__births"]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, at = None, None

        def end() -> list[dict]:
            return [dict(zip(key, at[:-1], strict=True)) | {"__stretch": at[-1], "__state": step.dump(), "__digest": step.digest(), "__births": step.births}] if step else []

        for pdf in pdfs:
            out = []
            for row in _records(pdf):
                now, state, first = (*(row[k] for k in key), row["__stretch"]), row.pop("__state"), row.pop("__first")
                if step is None or now != at:
                    out += end()
                    step, at = make(), now
                    if first and state is not None:
                        step.load(state)
                    step.begin(at[-1])
                if not first:
                    out += [dict(zip(key, at[:-1], strict=True)) | {"__stretch": at[-1]} | r for r in step(row)]
            yield _frame(out, [*key, *names, *told])
        yield _frame(end(), [*key, *names, *told])

    kind = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), schema, "__stretch long, __state binary, __digest string, __births long"])

    def go(stretches: DataFrame) -> DataFrame:
        """stretches: key, __stretch, __state."""
        mine = own.join(stretches.select(*key, "__stretch"), [*key, "__stretch"], "left_semi")
        begins = stretches.select(*(F.col(c) if c in (*key, "__stretch", "__state") else F.lit(None).cast(kinds[c]).alias(c) for c in [*own.columns, "__state"]), F.lit(True).alias("__first"))
        both = mine.withColumns({"__state": F.lit(None).cast("binary"), "__first": F.lit(False)}).unionByName(begins)
        placed = _dealt(both, [*key, "__stretch"]).sortWithinPartitions(*key, "__stretch", F.col("__first").desc(), *order)
        return cut_lineage(placed.mapInPandas(run, kind))

    done = go(own.select(*key, "__stretch").distinct().withColumn("__state", F.lit(None).cast("binary")))
    ends = done.where("__digest is not null").select(*key, *told)
    out, used = done.where("__digest is null").drop(*told[1:]), ends.select(*key, "__stretch", F.lit(make().digest()).alias("__used"))
    while True:
        before = ends.select(*key, (F.col("__stretch") + 1).alias("__stretch"), "__state", F.col("__digest").alias("__now"))
        other = used.join(before, [*key, "__stretch"]).where(F.col("__used") != F.col("__now"))
        first = F.min_by(F.struct("__stretch", "__state", "__now"), "__stretch").alias("first")
        again = cut_lineage(other.groupBy(*key).agg(first).select(*key, "first.*"))
        if again.isEmpty():
            return out, ends.select(*key, "__stretch", F.col("__births").alias("births"))
        done = go(again.drop("__now"))
        keys = [*key, "__stretch"]
        out = cut_lineage(out.join(again.select(*keys), keys, "left_anti").unionByName(done.where("__digest is null").drop(*told[1:])))
        ends = cut_lineage(ends.join(again.select(*keys), keys, "left_anti").unionByName(done.where("__digest is not null").select(*key, *told)))
        used = cut_lineage(used.join(again.select(*keys), keys, "left_anti").unionByName(again.select(*keys, F.col("__now").alias("__used"))))


def live(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], Step], schema: str, timeout_ms: int | None = None, buckets: int | None = None) -> DataFrame:
    """The same step on a stream: state by key, appended output; a key silent for ``timeout_ms`` of processing time is forgotten.

    Spark hands over and takes back each group by itself, which costs far more than a few rows of a step.
    With ``buckets`` keys are dealt to so many groups by their hash, and a group's state holds those of its
    keys: for many small keys that come often.  A micro-batch then writes the whole state of the buckets
    that it touches, and no key is forgotten.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = T.StructType.fromDDL(schema).fieldNames()

    def run(_: tuple, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        step, out = make(), []
        if state.exists:
            step.load(state.get[0])
        for row in _records(pd.concat(list(pdfs)).sort_values(order, kind="stable")):
            out += step(row)
        state.update((step.dump(),))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        if out:
            yield _frame(out, names)

    def run_bucket(_: tuple, pdfs: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, met, out = pickle.loads(state.get[0]) if state.exists else {}, {}, []
        for row in _records(pd.concat(list(pdfs)).drop(columns="__bucket").sort_values(order, kind="stable")):
            own = tuple(row[k] for k in key)
            if own not in met:
                met[own] = make().load(held[own]) if own in held else make()
            out += met[own](row)
        state.update((pickle.dumps(held | {k: step.dump() for k, step in met.items()}),))
        if out:
            yield _frame(out, names)

    if buckets:
        if timeout_ms:
            raise ValueError("a bucket has no timeout of its keys")
        dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
        return dealt.groupBy("__bucket").applyInPandasWithState(run_bucket, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*key).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def timed_replay(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], Timed], schema: str, time_col: str = "at", end: int | None = None) -> DataFrame:
    """Run a timed step over each key's rows in order of ``order``, the first of which is ``time_col`` (long, microseconds).

    Where a key is quiet for longer than the step remembers (``make().quiet``), nothing passes the gap: the
    stretches on both sides are separate tasks' work, whole and exact, so a key is cut as finely as its
    own silences allow.  At a key's end the timers fire up to ``end`` (None: all of them).  Fired rows carry
    the key.
    """
    names, quiet = T.StructType.fromDDL(schema).fieldNames(), make().quiet
    w = Window.partitionBy(*key).orderBy(*order)
    pause = F.col(time_col) - F.lag(time_col).over(w)
    last = F.lead(time_col).over(w).isNull()
    marked = rows.withColumns({"__new": F.coalesce(pause > quiet, F.lit(True)), "__last": last})
    marked = marked.withColumn("__stretch", F.sum(F.col("__new").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step, at, owner, open_end = None, None, {}, True

        def close() -> list[dict]:
            return [owner | r for r in step.until(end if open_end else None)] if step else []

        for pdf in pdfs:
            out = []
            for row in _records(pdf):
                own = (*(row[k] for k in key), row.pop("__stretch"))
                open_now = row.pop("__last")
                if step is None or own != at:
                    out += close()
                    step, at, owner = make(), own, {k: row[k] for k in key}
                open_end = open_now
                out += [owner | r for r in step.until(row[time_col])]
                out += [owner | r for r in step(row)]
            yield _frame(out, names)
        yield _frame(close(), names)

    placed = _dealt(marked, [*key, "__stretch"]).sortWithinPartitions(*key, "__stretch", *order)
    return placed.mapInPandas(run, schema)


def timed_live(rows: DataFrame, key: list[str], order: list[str], make: Callable[[], Timed], schema: str, time_col: str = "at") -> DataFrame:
    """The same step on a stream with a watermark: each table is a map state of its own, the clock a value state, what is due an event-time timer.

    Needs the RocksDB state store.  Rows behind the watermark are dropped by Spark; all others of a key may
    come in any micro-batch, in order of time.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    names, keys = T.StructType.fromDDL(schema).fieldNames(), key

    class Processor(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.maps = {name: handle.getMapState(name, *kinds) for name, kinds in make().tables.items()}
            self.clock = handle.getValueState("clock", "at long")

        def _load(self) -> tuple[Timed, dict]:
            step, held = make(), {}
            for name, state in self.maps.items():
                held[name] = {k[0]: tuple(v) for k, v in state.iterator()} if state.exists() else {}
                setattr(step, name, dict(held[name]))
            if self.clock.exists():
                step.clock = int(self.clock.get()[0])
            return step, held

        def _save(self, step: Timed, held: dict) -> None:
            for name, state in self.maps.items():
                now = getattr(step, name)
                for k in held[name].keys() - now.keys():
                    state.removeKey((k,))
                for k, v in now.items():
                    if held[name].get(k) != v:
                        state.updateValue((k,), v)
            if step.clock is not None:
                self.clock.update((step.clock,))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            due = step.due()
            if due is not None:
                self.handle.registerTimer(-(-due // 1000))

        def _told(self, own: tuple, out: list[dict]) -> Iterator[pd.DataFrame]:
            owner = dict(zip(keys, own, strict=True))
            return iter([_frame([owner | r for r in out], names)] if out else [])

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            step, held = self._load()
            out = []
            for row in _records(pd.concat(list(rows)).sort_values(order, kind="stable")):
                out += step.until(row[time_col]) + step(row)
            self._save(step, held)
            return self._told(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            step, held = self._load()
            out = step.until(timerValues.getCurrentWatermarkInMs() * 1000)
            self._save(step, held)
            return self._told(key, out)

        def close(self) -> None:
            pass

    return rows.groupBy(*key).transformWithStateInPandas(Processor(), schema, "append", "EventTime")
