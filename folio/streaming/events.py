"""Event-driven parts: daily totals, login limiter, expiring entries, last progress."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Failures that lock a key, and for how long, in milliseconds.
MOST_FAILURES, LOCK_MS = 5, 300_000

#: Seconds that a reading tick stands for.
TICK = 30

LIMITER = "key string, failures int, locked_until long, locks int, rejected int"


def step(state: tuple[int, int, int, int], time: int, success: bool) -> tuple[int, int, int, int]:
    """``(failures, locked until, locks, rejected)`` after an attempt.

    An attempt while locked is rejected and not counted. The fifth failure locks
    and starts the count again; a success forgets the key's failures.
    """
    failures, until, locks, rejected = state
    if time < until:
        return failures, until, locks, rejected + 1
    if success:
        return 0, 0, locks, rejected
    failures += 1
    if failures >= MOST_FAILURES:
        return 0, time + LOCK_MS, locks + 1, rejected
    return failures, until, locks, rejected


def limited(attempts: DataFrame) -> DataFrame:
    """The limiter's final state of each key of ``attempts(key, time, event_id, success)``.

    A fold over a key's attempts in the order of time and id, in built-in
    expressions. An attempt takes 17 bytes in the array; for keys whose attempts
    don't fit a task even so, use ``limited_stream``, which holds four numbers a
    key.
    """
    start = F.struct(F.lit(0).alias("failures"), F.lit(0).cast("long").alias("until"), F.lit(0).alias("locks"), F.lit(0).alias("rejected"))

    def fold(state: Column, x: Column) -> Column:
        made = lambda failures, until, locks, rejected: F.struct(failures.alias("failures"), until.alias("until"), locks.alias("locks"), rejected.alias("rejected"))
        none, never, failures = F.lit(0), F.lit(0).cast("long"), state["failures"] + 1
        return (
            F.when(x["time"] < state["until"], made(state["failures"], state["until"], state["locks"], state["rejected"] + 1))
            .when(x["success"], made(none, never, state["locks"], state["rejected"]))
            .when(failures >= MOST_FAILURES, made(none, x["time"] + F.lit(LOCK_MS), state["locks"] + 1, state["rejected"]))
            .otherwise(made(failures, state["until"], state["locks"], state["rejected"]))
        )

    rows = attempts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("time", "event_id", "success"))).alias("all"))
    folded = rows.select("key", F.aggregate("all", start, fold).alias("s"))
    return folded.select("key", "s.failures", F.col("s.until").alias("locked_until"), "s.locks", "s.rejected")


class Limiter(StatefulProcessor):
    """Keeps a key's four numbers; attempts of a batch are taken in the order of time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "failures int, until long, locks int, rejected int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (0, 0, 0, 0)
        for row in pd.concat(list(rows)).sort_values(["time", "event_id"]).itertuples():
            state = step(state, row.time, bool(row.success))
        self.state.update(tuple(int(x) for x in state))
        yield pd.DataFrame([(key[0], *state)], columns=["key", "failures", "locked_until", "locks", "rejected"])

    def close(self) -> None:
        pass


def limited_stream(attempts: DataFrame) -> DataFrame:
    """``limited`` over a stream, one updated row a key and batch (needs the RocksDB state store)."""
    return attempts.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Limiter(), outputStructType=LIMITER, outputMode="Update", timeMode="None"
    )


#: Fixed value: how long a cached table of contents holds, in milliseconds.
CONTENTS_TTL = 300_000

LOOKUP = "book_url string, event_id long, contents string, hit boolean"


class Contents(StatefulProcessor):
    """Keeps a book's last table of contents; the store itself forgets entries that nobody renews.

    Events say when they happened, so whether an entry holds is judged by their
    times, the last millisecond included. The store's clock only frees memory, and
    later: an entry stays for two lifetimes of its own.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "contents string, updated_at long", ttlDurationMs=2 * self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        found = []
        for row in pd.concat(list(rows)).sort_values(["time", "event_id"]).itertuples():
            if isinstance(row.contents, str):
                entry = row.contents, int(row.time)
            else:
                hit = entry is not None and row.time - entry[1] <= self.ttl
                found.append((key[0], int(row.event_id), entry[0] if hit else None, hit))
        if entry is not None:
            self.entry.update(entry)
        yield pd.DataFrame(found, columns=["book_url", "event_id", "contents", "hit"])

    def close(self) -> None:
        pass


def contents_stream(events: DataFrame, ttl: int = CONTENTS_TTL) -> DataFrame:
    """What a cache of tables of contents answers: one row for each question of ``events(book_url, time, event_id, contents)``.

    An event with contents stores them, one without asks. Needs the RocksDB state
    store; as the store has a clock, the query goes on under any trigger until it is stopped.
    """
    return events.groupBy("book_url").transformWithStateInPandas(statefulProcessor=Contents(ttl), outputStructType=LOOKUP, outputMode="Append", timeMode="ProcessingTime")


def daily_reading(ticks: DataFrame, late: str = "31 days") -> DataFrame:
    """Seconds read a day from ticks ``(ts, book_url)``; state older than ``late`` is given up."""
    days = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    sums = days.groupBy(F.window("ts", "1 day").alias("w"), "book_url").agg((F.count("*") * TICK).alias("seconds"))
    return sums.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "book_url", "seconds")


def daily_requests(requests: DataFrame, late: str = "2 days") -> DataFrame:
    """Requests a day and path from ``(ts, path)``."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    counts = rows.groupBy(F.window("ts", "1 day").alias("w"), "path").agg(F.count("*").alias("requests"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "path", "requests")


def last_progress(updates: DataFrame) -> DataFrame:
    """The place of each book that arrived last, by ``seq``."""
    return updates.groupBy("user_namespace", "book_url").agg(F.max_by(F.struct("chapter_index", "chapter_pos"), "seq").alias("p")).select(
        "user_namespace", "book_url", "p.chapter_index", "p.chapter_pos"
    )


def frames(chunks: DataFrame) -> DataFrame:
    """Server-sent events of ``chunks(stream, seq, chunk)``: ``stream, place, event, data``.

    Chunks are joined in order and cut at blank lines; data lines of a block are
    joined by line breaks. What follows the last blank line is incomplete. A
    stream's text is one row.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    whole = F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["chunk"]), ""), "\r\n?", "\n")
    rows = chunks.groupBy("stream").agg(whole.alias("text"))
    blocks = F.split("text", "\n\n", -1)
    rows = rows.select("stream", F.posexplode(F.slice(blocks, 1, F.size(blocks) - 1)).alias("place", "block"))
    lines = F.split("block", "\n")
    value = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    rows = rows.select("stream", "place", F.coalesce(F.element_at(F.concat(F.array(F.lit("message")), value("event")), -1)).alias("event"), value("data").alias("d"))
    return rows.where(F.size("d") > 0).select("stream", "place", "event", F.array_join("d", "\n").alias("data"))


FRAME = "stream string, place int, event string, data string"


def cut_frames(text: str) -> tuple[list[tuple[str, str] | None], str]:
    """``(event, data)`` of each whole block of a text, none for a block without data, and the tail that is no block yet."""
    end = text[-1:] if text.endswith("\r") else ""  # half of a line break, perhaps
    *blocks, tail = text.removesuffix(end).replace("\r\n", "\n").replace("\r", "\n").split("\n\n")

    def value(line: str, name: str) -> str:
        return line[len(name) + 1 :].removeprefix(" ")

    def frame(lines: list[str]) -> tuple[str, str] | None:
        names = ["message", *(value(x, "event") for x in lines if x.startswith("event:"))]
        data = [value(x, "data") for x in lines if x.startswith("data:")]
        return (names[-1], "\n".join(data)) if data else None

    return [frame(block.split("\n")) for block in blocks], tail + end


class Frames(StatefulProcessor):
    """Keeps a stream's tail, the chunks that came too early, and a clock for those that don't come.

    What is held is the text behind the last whole frame, and early chunks until
    the ones before them arrive or are given up. A chunk that comes again, or
    after it was given up, is passed over.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "next int, place int, tail string, waiting_for int")
        self.early = handle.getMapState("early", "seq int", "chunk string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.at.get()) if self.at.exists() else (0, 0, "", -1)
        for frame in rows:
            for seq, chunk in zip(frame["seq"].tolist(), frame["chunk"].tolist()):
                if seq >= state[0]:
                    self.early.updateValue((int(seq),), (chunk or "",))
        yield self._taken(key, state, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.at.get())
        waiting = sorted(k[0] for k in self.early.keys())
        if waiting and state[3] == state[0]:
            # the chunk is lost, and what it would have completed with it
            state = (waiting[0], state[1], "", -1)
        yield self._taken(key, state, timerValues)

    def _taken(self, key, state: tuple, timerValues) -> pd.DataFrame:
        following, place, tail, waiting_for = state
        found = []
        while self.early.containsKey((following,)):
            blocks, tail = cut_frames(tail + self.early.getValue((following,))[0])
            self.early.removeKey((following,))
            found += [(key[0], place + k, *x) for k, x in enumerate(blocks) if x]
            place, following = place + len(blocks), following + 1
        if waiting_for != following and any(True for _ in self.early.keys()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            waiting_for = following
        self.at.update((following, place, tail, waiting_for))
        return pd.DataFrame(found, columns=["stream", "place", "event", "data"])

    def close(self) -> None:
        pass


def frames_stream(chunks: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """``frames`` over a stream of ``chunks(stream, seq, chunk)``, ``seq`` from 0, in any order (needs the RocksDB state store).

    A chunk that is missing for ``wait_ms`` while later ones are there is given
    up together with the tail before it; for that clock's sake the query goes on
    under any trigger until it is stopped.
    """
    return chunks.groupBy("stream").transformWithStateInPandas(statefulProcessor=Frames(wait_ms), outputStructType=FRAME, outputMode="Append", timeMode="ProcessingTime")
