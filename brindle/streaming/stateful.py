"""Stateful operators: limiter, cache with expiry, debounce, windows, deduplication, incremental updates.

Each keyed operator is one function over a key's events in time order; ``…_batch`` runs it over a
table, ``…_stream`` over a stream with the state kept between micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A limiter's requests and seconds, a cache's seconds, a trigger's seconds.
LIMIT, WINDOW_S, TTL_S, DEBOUNCE_S = 10, 60, 3600, 2


def admit(times, log: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """A sliding-log limiter: an event is admitted if fewer than ``limit`` admitted ones are within ``window`` before it.

    One exactly ``window`` old still counts; rejected events leave no trace, so each answer depends on those before.
    """
    log, out = list(log), []
    for t in times:
        while log and t - log[0] > window:
            log.pop(0)
        ok = len(log) < limit
        if ok:
            log.append(t)
        out.append(ok)
    return out, log


def hits(times, written: int | None, ttl: int) -> tuple[list[bool], int | None]:
    """A cache entry with expiry: a miss writes it and starts the clock, a hit doesn't restart it."""
    out = []
    for t in times:
        hit = written is not None and t - written < ttl
        if not hit:
            written = t
        out.append(hit)
    return out, written


def fires(times, last: int | None, quiet: int) -> tuple[list[bool], int | None]:
    """A debounced trigger: an event fires if ``quiet`` has passed since the last that fired; the first fires."""
    out = []
    for t in times:
        fire = last is None or (t - last >= quiet and t != last)
        if fire:
            last = t
        out.append(fire)
    return out, last


def _batch(events: DataFrame, decide: Callable, name: str) -> DataFrame:
    """events(key, at, …) with the decision for each, per key in order of at; ties in order of the other columns.

    Rows are sorted by key and time and pass through in batches, with the open key's state carried along: a
    key with most of the events never stands in memory whole.
    """
    others = [c for c in events.columns if c not in ("key", "at")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + f", {name} boolean"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for rows in batches:
            out: list[bool] = []
            runs = (rows["key"] != rows["key"].shift()).cumsum()
            for _, run in rows.groupby(runs, sort=False):
                if run["key"].iloc[0] != key:
                    key, state = run["key"].iloc[0], None
                made, state = decide(run["at"].tolist(), state)
                out += made
            yield rows.assign(**{name: out})

    return events.repartition("key").sortWithinPartitions("key", "at", *others).mapInPandas(work, schema)


def limit_batch(events: DataFrame, limit: int = LIMIT, window: int = WINDOW_S) -> DataFrame:
    return _batch(events, lambda times, log: admit(times, log or [], limit, window), "admitted")


def cache_batch(events: DataFrame, ttl: int = TTL_S) -> DataFrame:
    return _batch(events, lambda times, written: hits(times, written, ttl), "hit")


def debounce_batch(events: DataFrame, quiet: int = DEBOUNCE_S) -> DataFrame:
    return _batch(events, lambda times, last: fires(times, last, quiet), "fired")


#: Groups that a stream's keys fall into by their hash: a call, its state and its timer are a group's, not a key's.
GROUPS = 128


class _Decider(StatefulProcessor):
    """Decides events from the times that their keys keep, which fall when they can't matter any more.

    ``decide(times, kept)`` gives a key's decisions and its new times to keep; these live for ``lives`` microseconds
    after the last of them, by the events' clock.  A group's timer is set for the first of its keys' times to fall, and
    once the watermark is past that clears all that have.
    """

    def __init__(self, decide: Callable, name: str, lives: int):
        self.decide, self.name, self.lives = decide, name, lives

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "key string", "at array<long>")

    def _falls(self, times: list[int]) -> int:
        """The millisecond at which a key's times fall."""
        return (times[-1] + self.lives) // 1000 + 1

    def _load(self) -> dict[str | None, list[int]]:
        """The times of all keys; a key that isn't null is stored behind a mark."""
        return {key[0][1:] if key[0] else None: list(times[0]) for key, times in self.kept.iterator()}

    def _store(self, kept: dict[str | None, list[int]], new: dict[str | None, list[int]]) -> None:
        """Writes what is new of a group's times, and sets its timer."""
        for name, times in new.items():
            key = ("" if name is None else "k" + name,)
            if times:
                self.kept.updateValue(key, (times,))
            elif name in kept:
                self.kept.removeKey(key)
        falls = min((self._falls(times) for times in (kept | new).values() if times), default=None)
        for old in list(self.handle.listTimers()):
            if old != falls:
                self.handle.deleteTimer(old)
        if falls is not None:
            self.handle.registerTimer(falls)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [(r["key"].to_numpy(object), r["event_id"].to_numpy(), r["at"].to_numpy().astype("datetime64[us]").astype("int64")) for r in rows]
        keys, ids, times = (np.concatenate(x) for x in zip(*parts))
        codes = pd.factorize(keys, use_na_sentinel=False)[0]
        order = np.lexsort((ids, times, codes))
        keys, ids, times, codes = keys[order], ids[order], times[order], codes[order]
        edges = [*np.flatnonzero(np.diff(codes, prepend=-1)).tolist(), len(codes)]
        kept, new, decisions = self._load(), {}, []
        for first, last in pairwise(edges):
            name = keys[first] if isinstance(keys[first], str) else None
            made, new[name] = self.decide(times[first:last].tolist(), kept.get(name, []))
            decisions += made
        self._store(kept, new)
        for first in range(0, len(ids), 10_000):
            some = slice(first, first + 10_000)
            yield pd.DataFrame({"key": keys[some], "event_id": ids[some], "at": times[some].astype("datetime64[us]"), self.name: decisions[some]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        kept = self._load()
        self._store(kept, {name: [] for name, times in kept.items() if self._falls(times) <= now})
        return iter(())

    def close(self) -> None:
        pass


def _stream(events: DataFrame, decide: Callable, name: str, lives: int, late: str) -> DataFrame:
    """events(key string, event_id long, at timestamp) as a stream, with the decision for each.

    Events of a key may come in any order inside a micro-batch, and in order of time between them; what is behind
    the watermark is dropped.  Keys come in GROUPS groups: a call for each key and micro-batch costs far more than its
    events.  A group's events of one micro-batch are held; of its state, a row a key, what has changed is written.  State is kept in
    RocksDB, which this sets where the session has chosen nothing.
    """
    conf, provider = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    if not conf.get(provider, "").endswith("RocksDBStateStoreProvider"):
        conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    group = F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int").alias("group")
    timed = events.select(group, "key", "event_id", "at").withWatermark("at", late)
    return timed.groupBy("group").transformWithStateInPandas(_Decider(decide, name, lives), f"key string, event_id long, at timestamp, {name} boolean", "append", "EventTime")


def limit_stream(events: DataFrame, limit: int = LIMIT, window: int = WINDOW_S, late: str = "10 seconds") -> DataFrame:
    """A limiter of ``limit`` events in ``window`` seconds a key; its log falls ``window`` after the last that was admitted."""
    us = window * 1_000_000
    return _stream(events, lambda times, log: admit(times, log, limit, us), "admitted", us, late)


def _of_one(decide: Callable, span: int) -> Callable:
    """A decider whose state is one time or none."""

    def work(times: list[int], kept: list[int]) -> tuple[list[bool], list[int]]:
        out, last = decide(times, kept[0] if kept else None, span)
        return out, [] if last is None else [last]

    return work


def cache_stream(events: DataFrame, ttl: int = TTL_S, late: str = "10 seconds") -> DataFrame:
    """Whether each question finds its answer; an entry's state falls with the entry, ``ttl`` seconds after it was written."""
    return _stream(events, _of_one(hits, ttl * 1_000_000), "hit", ttl * 1_000_000, late)


def debounce_stream(events: DataFrame, quiet: int = DEBOUNCE_S, late: str = "10 seconds") -> DataFrame:
    """Which events fire; a trigger's state falls ``quiet`` seconds after the last that fired."""
    return _stream(events, _of_one(fires, quiet * 1_000_000), "fired", quiet * 1_000_000, late)


def windowed_counts(events: DataFrame, time: str, label: str, length: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, label, n, total) of a stream's windows, as they close behind the watermark."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    w = F.window("_t", length, slide) if slide else F.window("_t", length)
    return timed.groupBy(w.alias("w"), label).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), label, "n", "total")


def dedupe_stream(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark([key]).drop("_t")


def add_to_kb(path: str, buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch's new texts to the knowledge base at ``path``, each with the version that added it.

    The base keeps each text's hash, and lies in folders by version and by bucket of the hash.  A batch hashes its own
    texts alone, and reads the hashes, no texts, of the buckets that it touches.  A batch that is run again after a
    failure replaces its own version's folder, so nothing is added twice.
    """
    from ..functions.text import content_hash
    from ..operators.dedupe import first_of_each

    def add(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("text_hash", content_hash("text"))
        hashed = hashed.withColumn("bucket", F.pmod(F.xxhash64("text_hash"), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in hashed.select("bucket").distinct().collect()]  # ``buckets`` numbers at most
        try:
            base = spark.read.schema("text_hash string, kb_version long, bucket int").parquet(path)
            known = base.where((F.col("kb_version") < version) & F.col("bucket").isin(touched)).select("text_hash", "bucket")
            hashed = hashed.join(known, ["text_hash", "bucket"], "left_anti").select(*hashed.columns)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
        new = first_of_each(hashed, F.col("text_hash"), "doc_id").repartition("bucket")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/kb_version={version}")

    return add


#: The edges of the latency histogram, in seconds.
LATENCY_EDGES = (0.01, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0)


def _measured(keys: list) -> dict:
    seconds = F.col("latency")
    buckets = F.array(*[F.count_if(seconds <= e) for e in LATENCY_EDGES], F.count("latency"))
    return {"requests": F.count("*"), "errors": F.count("error"), "seconds": F.sum(seconds), "buckets": buckets, "sketch": F.kll_sketch_agg_double(seconds)}


def request_metrics(requests: DataFrame, length: str = "1 minute", late: str | None = "10 minutes") -> DataFrame:
    """(start, route, method, status, error, requests, errors, seconds, buckets, sketch) of windows of a length.

    ``requests(at timestamp, route, method, status, error, latency)``, a table or a stream; error is null where there
    was none.  buckets: how many took LATENCY_EDGES seconds at most each, and in all; sketch: the latencies as a
    mergeable KLL sketch, for ``latency_quantiles``.  Of a stream a window comes out once the watermark, ``late``
    behind the newest request, has passed it; requests behind that are dropped.  late None: a table.
    """
    timed = requests.withWatermark("at", late) if late else requests
    keys = [F.window("at", length).alias("w"), "route", "method", "status", "error"]
    grouped = timed.groupBy(*keys).agg(*[c.alias(n) for n, c in _measured(keys).items()])
    return grouped.select(F.col("w.start").alias("start"), *grouped.columns[1:])


def latency_quantiles(measured: DataFrame, by: list[str], quantiles: list[float]) -> DataFrame:
    """``by`` and quantiles of the latency from stored metrics: their sketches are merged, no request is read again."""
    merged = measured.where("sketch is not null").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("s"))
    return merged.select(*by, F.kll_sketch_get_n_double("s").alias("n"), *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"p{round(q * 100)}") for q in quantiles])
