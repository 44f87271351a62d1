"""Operators over event streams that remember something per key, as ``Steps``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.streaming.steps import Batch, Steps


def throttle(events: DataFrame, key: str, least: int) -> Steps:
    """(key, event_id, us): events at least ``least`` microseconds after the last one that was kept.

    ``events`` has (key, us, event_id). State: the time of the last kept event.
    """
    def fold(memory, row):
        if memory["last"] is None or row["us"] - memory["last"] >= least:
            return {"last": row["us"]}, row
        return memory, None

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        return batch.step("throttle", rows.select(key, "event_id", "us"), key, ["us", "event_id"], fold, {"last": None},
                          "event_id bigint, us bigint", "last bigint")

    return Steps(events, plan)


def classify_passes(passes: DataFrame, key: str) -> Steps:
    """(key, event_id, kind): ``idle`` without content, ``payload`` for content that differs from what was last
    sent, else ``heartbeat``. ``passes`` has (key, us, event_id, content). State: a hash of what was last sent.
    """
    def fold(memory, row):
        if row["content"] is None:
            return memory, {"event_id": row["event_id"], "kind": "idle"}
        kind = "heartbeat" if row["content"] == memory["sent"] else "payload"
        return {"sent": row["content"]}, {"event_id": row["event_id"], "kind": kind}

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        hashed = rows.select(key, "us", "event_id", F.sha1("content").alias("content"))
        return batch.step("passes", hashed, key, ["us", "event_id"], fold, {"sent": None}, "event_id bigint, kind string", "sent string")

    return Steps(passes, plan)


def page_turns(passes: DataFrame, key: str, turn: float = 0.5) -> Steps:
    """(key, event_id): pages that confirm a turn: unlike the adopted page, but like the page before, which was unlike too.

    ``passes`` has (key, us, event_id, lines); two pages are alike when at least ``turn`` of the lines of the larger are shared.
    State: the lines of the adopted page and of one that waits for confirmation.
    """
    def shared(a, b):
        return len(set(a) & set(b)) / max(len(set(a)), len(set(b)), 1)

    def fold(memory, row):
        adopted, waiting, lines = memory["adopted"], memory["waiting"], row["lines"] or []
        if adopted is None or shared(lines, adopted) >= turn:
            return {"adopted": lines, "waiting": None}, None
        if waiting is not None and shared(lines, waiting) >= turn:
            return {"adopted": lines, "waiting": None}, {"event_id": row["event_id"]}
        return {"adopted": adopted, "waiting": lines}, None

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        return batch.step("turns", rows.select(key, "us", "event_id", "lines"), key, ["us", "event_id"], fold,
                          {"adopted": None, "waiting": None}, "event_id bigint", "adopted array<string>, waiting array<string>")

    return Steps(passes, plan)


def rebuild_gate(passes: DataFrame, key: str, alike: float = 0.85, streak: int = 2, jitter: float = 3) -> Steps:
    """(key, event_id, verdict): what a reader's layer does with the next pass of its page.

    ``identical`` lines stay; voted passes (``vote`` >= 2) with as many glyphs in each line are ``patched``;
    pages that share more than ``alike`` of their lines with the adopted one are ``kept`` over, ``streak`` times in
    a row at most; all others, and those whose frame or first glyphs moved, are ``rebuilt``. Patched and rebuilt
    pages become the adopted one.

    ``passes`` has (key, us, event_id, lines, xs, ys, frame, vote): texts of the lines and places of their first
    glyphs. State: the adopted lines with their places and frame, and the length of the streak.
    """
    def fold(memory, row):
        now = row["lines"] or []
        page = {"lines": now, "xs": row["xs"] or [], "ys": row["ys"] or [], "frame": row["frame"], "streak": 0}

        def tell(verdict, memory):
            return memory, {"event_id": row["event_id"], "verdict": verdict}

        lines = memory["lines"]
        if not lines:
            return tell("rebuilt", page)
        at = dict(zip(lines, zip(memory["xs"], memory["ys"])))
        shift = max((max(abs(x - at[t][0]), abs(y - at[t][1])) for t, x, y in zip(now, page["xs"], page["ys"]) if t in at), default=0)
        if memory["frame"] == row["frame"] and shift <= jitter:
            if now == lines:
                return tell("identical", memory | {"streak": 0})
            if row["vote"] is not None and row["vote"] >= 2 and now and [len(t) for t in now] == [len(t) for t in lines]:
                return tell("patched", page)
            before = set(lines)
            if sum(t in before for t in now) / max(len(now), len(before)) > alike and memory["streak"] < streak:
                return tell("kept", memory | {"streak": memory["streak"] + 1})
        return tell("rebuilt", page)

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        wanted = rows.select(key, "us", "event_id", "lines", F.col("xs").cast("array<double>"), F.col("ys").cast("array<double>"), "frame", "vote")
        return batch.step("gate", wanted, key, ["us", "event_id"], fold, {"lines": [], "xs": [], "ys": [], "frame": None, "streak": 0},
                          "event_id bigint, verdict string",
                          "lines array<string>, xs array<double>, ys array<double>, frame string, streak int")

    return Steps(passes, plan)


def stall_alerts(events: DataFrame, key: str, ts: str, silence: int, late: int) -> Steps:
    """(key, us): one alert per silence of at least ``silence`` microseconds, with the time of the event before it.

    The last silence of a key is told once the clock passes it: the latest time of all keys, in whole milliseconds,
    less ``late`` microseconds. Events before the clock of an earlier batch are dropped. State: the time of the last event.
    """
    def clock(states: DataFrame) -> int | None:
        top = states.agg(F.max("state.last")).first()[0]
        return None if top is None else top // 1000 * 1000 - late

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        field = rows.schema[key]
        was = batch.states("stalls", field, "last bigint")
        before = clock(was)

        def told(last):
            return before is not None and last + silence <= before

        def fold(memory, row):
            last, us = memory["last"], row["us"]
            if before is not None and us < before:
                return memory, None
            over = last is not None and us - last >= silence and not told(last)
            return {"last": us}, {"us": last} if over else None

        timed = rows.select(key, F.unix_micros(ts).alias("us"))
        found = batch.step("stalls", timed, key, ["us"], fold, {"last": None}, "us bigint", "last bigint")
        now = batch.after().states("stalls", field, "last bigint")
        after = clock(now)
        if after is None:
            return found
        silent = now.select(key, F.col("state.last").alias("us")).where(F.col("us") + silence <= after)
        if before is not None:
            old = was.select(F.col(key).alias("_key"), F.col("state.last").alias("_us")).where(F.col("_us") + silence <= before)
            silent = silent.join(old, F.col(key).eqNullSafe(F.col("_key")) & (F.col("us") == F.col("_us")), "left_anti")
        return found.unionByName(silent)

    return Steps(events, plan)
