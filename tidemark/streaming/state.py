"""Streams with state of their own, kept in RocksDB: totals, a cache with time to live, the ledger of recommendations.

Each result depends on the rows alone, not on how files make up micro-batches or in what order they come: what a later row
can still change is decided again when it comes, and a line with a higher ``version`` takes the place of those before it.
How far back rows may still come is a parameter; without it everything is kept.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Processors go to the workers by value: the one that the driver starts to ask for their state has no other way to know them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The store of the state: on the executors' disks and in the folder of checkpoints, with changes logged batch by batch.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def on_disk(spark: SparkSession):
    """Streams that start within keep their state in RocksDB; the session's settings come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def newest(lines: DataFrame, key: str) -> DataFrame:
    """Of the lines of a key the one of the highest version, without it."""
    rest = [c for c in lines.columns if c not in (key, "version")]
    last = lines.groupBy(key).agg(F.max_by(F.struct(*rest), "version").alias("last"))
    return last.select(key, *(F.col(f"last.{c}") for c in rest))


# ------------------------------------------------------------------ totals

class Totals(StatefulProcessor):
    """Number and sum of a key's rows. With a time to live, state not touched for so long (by the clock) goes, and the key's
    next rows are counted from zero under a later epoch."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double, epoch long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, total, epoch = self.state.get() if self.state.exists() else (0, 0.0, timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame.value.sum())
        self.state.update((n, total, epoch))
        yield pd.DataFrame({"user_id": [key[0]], "epoch": [epoch], "n": [n], "total": [total]})

    def close(self) -> None:
        pass


def running_totals(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(user_id, epoch, n, total): a user's total is the sum over the epochs of the line of most rows of each."""
    kept = events.select("user_id", "value").groupBy("user_id")
    return kept.transformWithStateInPandas(Totals(ttl_ms), "user_id long, epoch long, n long, total double", "update", "ProcessingTime" if ttl_ms else "none")


# ------------------------------------------------------------------ cache

class Cache(StatefulProcessor):
    """Requests of a key in order of (t, event_id): a fetch if what is stored is older than ``ttl``, else the cache.

    Kept are the time of the last fetch that is final, and the requests after it that an earlier one could still change."""

    STATE = "since long, t array<long>, ids array<long>, storable array<boolean>, version long"

    def __init__(self, ttl: int, late: int | None) -> None:
        self.ttl, self.late = ttl, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("requests", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, t, ids, storable, version = self.state.get() if self.state.exists() else (None, [], [], [], 0)
        new = pd.concat(list(rows))
        t, ids = np.append(np.array(t, dtype=np.int64), new.t), np.append(np.array(ids, dtype=np.int64), new.event_id)
        storable = np.append(np.array(storable, dtype=bool), new.storable.astype(bool))
        order = np.lexsort((ids, t))
        t, ids, storable = t[order], ids[order], storable[order]
        fetched, stored = np.zeros(len(t), dtype=bool), since
        for i in range(len(t)):
            if stored is None or t[i] - stored > self.ttl:
                fetched[i] = True
                stored = int(t[i]) if storable[i] else stored
        yield pd.DataFrame({"event_id": ids, "fetched": fetched, "version": version})
        final = 0 if self.late is None else int(np.searchsorted(t, t[-1] - self.late))
        kept = np.flatnonzero(fetched[:final] & storable[:final])
        since = int(t[kept[-1]]) if len(kept) else since
        self.state.update((since, t[final:].tolist(), ids[final:].tolist(), storable[final:].tolist(), version + 1))

    def close(self) -> None:
        pass


def cache_log(requests: DataFrame, key: str, ttl: int, late: int | None = None) -> DataFrame:
    """(event_id, fetched, version) of requests (key, t, event_id, storable); ``late``: by how much a request may come after
    a later one of its key. An answer that is not storable leaves the cache as it is."""
    kept = requests.select(key, "t", "event_id", "storable").groupBy(key)
    return kept.transformWithStateInPandas(Cache(ttl, late), "event_id long, fetched boolean, version long", "update", "none")


# ------------------------------------------------------------------ ledger

#: Lines of the stream: recommendations (kind entry) and prices (kind price, value) by ticker; t in microseconds.
LINE = "kind string, ticker string, t long, id string, action string, rec_price double, target double, stop double, value double"
ENTRY = "id string, t long, action string, rec_price double, target double, stop double, status string, resolved long, last_t long, last_price double"
RESULT = "id string, ticker string, action string, status string, resolved long, last_price double, return_pct double, version long"


class Ledger(StatefulProcessor):
    """The recommendations of a ticker and what its prices make of them.

    A price after a recommendation resolves it: a purchase when the target or the stop is reached, any when it is older than
    ``expires``. The first such price in time counts, whatever the order in which prices come. Prices are kept for
    recommendations that come later than they, for ``late`` at most; a resolved recommendation goes when event time has
    passed its expiry by as much, which a timer sees to."""

    def __init__(self, expires: int, late: int | None) -> None:
        self.expires, self.late = expires, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", ENTRY)
        self.prices = handle.getValueState("prices", "t array<long>, value array<double>, version long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        fields = [f.split() for f in ENTRY.split(", ")]
        # Whole numbers with nulls come as floats, which a long would not take.
        plain = lambda v, kind: None if pd.isna(v) else int(v) if kind == "long" else v
        self.entries.put([tuple(plain(v, kind) for v, (_, kind) in zip(row, fields, strict=True)) for row in initialState[[name for name, _ in fields]].itertuples(index=False)])

    def _seen(self, e: dict, t: np.ndarray, value: np.ndarray) -> bool:
        """Whether prices in order of time change the entry, which is changed in place."""
        at = slice(int(np.searchsorted(t, e["t"], side="right")), None if e["resolved"] is None else int(np.searchsorted(t, e["resolved"])))
        t, value = t[at], value[at]
        if not len(t):
            return False
        target, stop = (np.nan if e[c] is None or e["action"] != "buy" else e[c] for c in ("target", "stop"))
        hit, stopped, old = value >= target, value <= stop, t - e["t"] > self.expires
        ends = np.flatnonzero(hit | stopped | old)
        if len(ends):
            i = int(ends[0])
            status = "target" if hit[i] else "stopped" if stopped[i] else "expired"
            e.update(status=status, resolved=int(t[i]), last_t=int(t[i]), last_price=float(value[i]))
        elif e["resolved"] is None and (e["last_t"] is None or t[-1] >= e["last_t"]):
            e.update(last_t=int(t[-1]), last_price=float(value[-1]))
        else:
            return False
        return True

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        old_t, old_value, version = self.prices.get() if self.prices.exists() else ([], [], 0)
        lines = pd.concat(list(rows))
        new = lines[lines.kind == "price"].sort_values(["t", "value"])
        t, value = new.t.to_numpy(np.int64), new.value.to_numpy(float)
        every = sorted(zip([*old_t, *t.tolist()], [*old_value, *value.tolist()], strict=True))
        every_t, every_value = np.array([p[0] for p in every], dtype=np.int64), np.array([p[1] for p in every], dtype=float)
        entries, out = [dict(zip(names, e, strict=True)) for e in (self.entries.get() if self.entries.exists() else [])], []
        for e in entries:
            if self._seen(e, t, value):
                out.append(e)
        for row in lines[lines.kind == "entry"].itertuples(index=False):
            plain = {c: None if pd.isna(getattr(row, c)) else getattr(row, c) for c in names[:6]}
            e = plain | {"t": int(row.t), "status": "open", "resolved": None, "last_t": None, "last_price": None}
            self._seen(e, every_t, every_value)
            entries.append(e)
            out.append(e)
        if entries:
            self.entries.put([tuple(e[c] for c in names) for e in entries])
        first = 0 if self.late is None or not len(every) else int(np.searchsorted(every_t, every_t[-1] - self.late))
        self.prices.update((every_t[first:].tolist(), every_value[first:].tolist(), version + 1))
        if self.late is not None and entries:
            self.handle.registerTimer(int(min(e["t"] for e in entries) + self.expires + self.late) // 1000 + 1)
        gain = lambda e: None if not e["rec_price"] or e["last_price"] is None else (e["last_price"] - e["rec_price"]) / e["rec_price"] * 100
        yield pd.DataFrame([(e["id"], key[0], e["action"], e["status"], e["resolved"], e["last_price"], gain(e), version) for e in out], columns=[f.split()[0] for f in RESULT.split(", ")]).astype({"resolved": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        until = timerValues.getCurrentWatermarkInMs() * 1000 - self.expires - self.late
        entries = [e for e in (self.entries.get() if self.entries.exists() else []) if e[names.index("resolved")] is None or e[1] > until]
        self.entries.put(entries) if entries else self.entries.clear()
        yield pd.DataFrame([], columns=[f.split()[0] for f in RESULT.split(", ")])

    def close(self) -> None:
        pass


def ledger(entries: DataFrame, prices: DataFrame, *, expires: int = 90 * 86_400_000_000, late: int | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(id, ticker, action, status, resolved, last_price, return_pct, version) of recommendations as prices come in.

    ``entries`` (ticker, t, id, action, rec_price, target, stop) and ``prices`` (ticker, t, value) are streams, ``stored``
    (ticker and the columns of ENTRY) is the ledger so far. Only the action ``buy`` meets target and stop. Without ``late``
    no recommendation and no price is ever let go.
    """
    columns = [f.rsplit(" ", 1) for f in LINE.split(", ")]
    lined = lambda df, kind: df.select(*(F.lit(kind).alias(c) if c == "kind" else F.col(c).cast(k).alias(c) if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in columns))
    both = lined(entries, "entry").unionByName(lined(prices, "price"))
    if late is not None:
        both = both.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", "0 seconds")
    start = stored.groupBy("ticker") if stored is not None else None
    return both.groupBy("ticker").transformWithStateInPandas(Ledger(expires, late), RESULT, "update", "none" if late is None else "EventTime", initialState=start)
