"""Replays of caches and ledgers over an event log, one group of keys at a time.

Each group (a consumer) is replayed in order; its state is bounded by the
cache's capacity, rows stream through in batches sorted by Spark."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _replay(log: DataFrame, group: str, order: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Partitions by group, sorts within, and runs a state machine for each group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine = None, None
        for frame in frames:
            for key, rows in frame.groupby(group, sort=False):
                if machine is None or key != now:
                    now, machine = key, make()
                yield machine(rows)

    return log.repartition(group).sortWithinPartitions(group, order).mapInPandas(run, schema)


def lru(log: DataFrame, capacity: int, kind: str = "lru") -> DataFrame:
    """log (consumer, seq, key) with ``hit`` by a cache of ``capacity`` entries for
    each consumer; ``kind`` is lru or fifo."""

    def make():
        held: OrderedDict = OrderedDict()

        def machine(rows: pd.DataFrame) -> pd.DataFrame:
            hits = []
            for key in rows["key"]:
                hit = key in held
                hits.append(hit)
                if hit and kind == "lru":
                    held.move_to_end(key)
                elif not hit:
                    held[key] = True
                    if len(held) > capacity:
                        held.popitem(last=False)
            return pd.DataFrame({"consumer": rows["consumer"], "seq": rows["seq"], "hit": hits})

        return machine

    return _replay(log.select("consumer", "seq", "key"), "consumer", "seq", make, "consumer long, seq long, hit boolean")


def ttl(log: DataFrame, capacity: int, ttl_ms: int) -> DataFrame:
    """log (consumer, seq, ms, key): hits of an LRU cache whose entries expire."""

    def make():
        held: OrderedDict = OrderedDict()

        def machine(rows: pd.DataFrame) -> pd.DataFrame:
            hits = []
            for key, ms in zip(rows["key"], rows["ms"], strict=True):
                hit = key in held and ms - held[key] <= ttl_ms
                hits.append(hit)
                if not hit:
                    held[key] = ms
                held.move_to_end(key)
                if len(held) > capacity:
                    held.popitem(last=False)
            return pd.DataFrame({"consumer": rows["consumer"], "seq": rows["seq"], "hit": hits})

        return machine

    return _replay(log.select("consumer", "seq", "ms", "key"), "consumer", "seq", make, "consumer long, seq long, hit boolean")


def ledger(log: DataFrame, limit: int) -> DataFrame:
    """log (consumer, seq, bytes): positive rows reserve, negative ones release; a
    reservation beyond ``limit`` is refused.  (consumer, seq, granted, held)"""

    def make():
        state = {"held": 0}

        def machine(rows: pd.DataFrame) -> pd.DataFrame:
            granted, held = [], []
            for n in rows["bytes"]:
                fits = state["held"] + n <= limit
                if fits:
                    state["held"] = max(0, state["held"] + int(n))
                granted.append(fits)
                held.append(state["held"])
            return pd.DataFrame({"consumer": rows["consumer"], "seq": rows["seq"], "granted": granted, "held": held})

        return machine

    return _replay(log.select("consumer", "seq", "bytes"), "consumer", "seq", make, "consumer long, seq long, granted boolean, held long")


def on_change(log: DataFrame, least: float) -> DataFrame:
    """log (consumer, seq, value): the rows that differ by more than ``least`` from
    the last row that was kept; the first is kept."""

    def make():
        state: dict[str, float | None] = {"last": None}

        def machine(rows: pd.DataFrame) -> pd.DataFrame:
            keep = []
            for v in rows["value"]:
                new = state["last"] is None or abs(v - state["last"]) > least
                if new:
                    state["last"] = v
                keep.append(new)
            return rows[pd.Series(keep, index=rows.index)]

        return machine

    return _replay(log.select("consumer", "seq", "value"), "consumer", "seq", make, "consumer long, seq long, value double")


def proxy(log: DataFrame, memory_ms: int, disk_ms: int, stale_ms: int) -> DataFrame:
    """log (key, seq, ms, answer) with the outcome of an image proxy for each request.

    ``answer`` is what the source would say: ok, same (unchanged), missing or error.
    Within ``memory_ms`` of the last good load a key is HIT-MEMORY, within
    ``disk_ms`` HIT; later the source is asked: same gives REVALIDATED, ok MISS,
    missing is remembered and NEGATIVE until it expires from memory, and an error
    gives STALE while the copy is not older than disk and stale time together,
    else ERROR.  Keys don't share anything, so each is replayed by itself."""

    def make():
        state = {"loaded": None, "missing": None}

        def one(ms: int, answer: str) -> str:
            age = None if state["loaded"] is None else ms - state["loaded"]
            if state["missing"] is not None and ms - state["missing"] <= memory_ms:
                return "NEGATIVE"
            if age is not None and age <= memory_ms:
                return "HIT-MEMORY"
            if age is not None and age <= disk_ms:
                return "HIT"
            if answer == "error":
                return "STALE" if age is not None and age <= disk_ms + stale_ms else "ERROR"
            if answer == "missing":
                state.update(loaded=None, missing=ms)
                return "MISSING"
            known = state["loaded"] is not None
            state.update(loaded=ms, missing=None)
            return "REVALIDATED" if answer == "same" and known else "MISS"

        def machine(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "outcome": [one(m, a) for m, a in zip(rows["ms"], rows["answer"], strict=True)]})

        return machine

    return _replay(log.select("key", "seq", "ms", "answer"), "key", "seq", make, "key long, seq long, outcome string")
