"""Operators over event streams: sessions that close by watermark, requests met by their replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.geometry import drop_covered, hit_test
from glyphlake.operators.sequence import as_of, changes_only
from glyphlake.streaming.steps import Batch, Steps


def stream_sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): a session closes once the watermark passes its last event by ``gap``."""
    found = (events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), F.col(key))
             .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")))
    return found.select(key, "start", "end", "n")


def correlate(messages: DataFrame, key: str, within: int) -> Steps:
    """(key, asked, told, latency, expired): each request with its first reply, or told to have expired.

    ``messages`` has (key: the request's id, us, kind: ``request`` or ``reply``, ok). A reply ends its request; if it
    failed, without a row. Replies to no open request are dropped, as are those more than ``within`` microseconds
    late; their request expires once the latest time seen passes that span. State: when an open request was made.
    """
    def fold(memory, row):
        asked = memory["asked"]
        if row["kind"] == "request":
            return {"asked": row["us"] if asked is None else asked}, None
        if asked is None:
            return None, None
        late = row["us"] - asked
        if late > within:
            return None, {"asked": asked, "expired": True}
        return None, {"asked": asked, "told": row["us"], "latency": late, "expired": False} if row["ok"] else None

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        events = rows.select(key, "us", (F.col("kind") == "reply").cast("int").alias("later"), "kind", "ok")
        last = batch.before("clock", "us bigint")
        before = last.agg(F.max("us")).first()[0]
        now = batch.keep("clock", rows.select("us").unionByName(last).agg(F.max("us").alias("us"))).first()[0]
        was = batch.states("open", rows.schema[key], "asked bigint")
        if before is not None:  # those told to have expired are forgotten
            was = was.where(F.col("state.asked") + within >= before)
        found = batch.step("open", events, key, ["us", "later"], fold, {"asked": None},
                           "asked bigint, told bigint, latency bigint, expired boolean", "asked bigint", was)
        if now is None:
            return found
        over = batch.after().states("open", rows.schema[key], "asked bigint").where(F.col("state.asked") + within < now)
        return found.unionByName(over.select(key, F.col("state.asked").alias("asked"), F.lit(None).cast("bigint").alias("told"),
                                             F.lit(None).cast("bigint").alias("latency"), F.lit(True).alias("expired")))

    return Steps(messages, plan)


def enrich_triggers(events: DataFrame, layers: DataFrame, boxes: DataFrame, covers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, us, event_id, .., box): the box that each event points at on the page its key saw then.

    ``events`` has (keys, us, event_id, px, py), ``layers`` (keys, us, page), ``boxes`` (page, box, x, y, w, h) without
    ruby, ``covers`` (page, x, y, w, h). Events under a cover, beside all boxes, or on the box of the key's event
    before are left out. Written for one batch of events, as of a ``foreachBatch`` sink.
    """
    seen = as_of(events, layers, keys, "us", "page")
    open_ = drop_covered(seen, covers.select("page", "x", "y", "w", "h"), ["page"], "event_id")
    met = hit_test(open_, boxes.select("page", "box", "x", "y", "w", "h"), ["page"], "event_id", "box")
    return changes_only(events.join(met.select("event_id", "box"), "event_id"), keys, ["us", "event_id"], "box")


def trigger_stream(events: DataFrame, boxes: DataFrame, covers: DataFrame, key: str) -> Steps:
    """The rows of ``enrich_triggers``, of one stream that carries both what is shown and what is pointed at.

    ``events`` has (key, us, event_id, px, py, page): a row with a page is the layer that the key sees from then on,
    any other points at (px, py). A layer counts for events of the same time. State: the page, and apart from it the
    box that was told last.
    """
    def show(memory, row):
        if row["page"] is not None:
            return {"page": row["page"]}, None
        return memory, None if memory["page"] is None else {c: row[c] for c in ("us", "event_id", "px", "py")} | memory

    def point(memory, row):
        if row["box"] == memory["box"]:
            return memory, None
        return {"box": row["box"]}, {"event_id": row["event_id"], "box": row["box"]}

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        kinds = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
        mixed = rows.select(key, "us", F.col("page").isNull().cast("int").alias("side"), "event_id", "px", "py", "page")
        seen = batch.step("layer", mixed, key, ["us", "side", "event_id"], show, {"page": None},
                          f"us bigint, event_id bigint, px {kinds['px']}, py {kinds['py']}, page {kinds['page']}", f"page {kinds['page']}")
        open_ = drop_covered(seen, covers.select("page", "x", "y", "w", "h"), ["page"], "event_id")
        met = hit_test(open_, boxes.select("page", "box", "x", "y", "w", "h"), ["page"], "event_id", "box")
        kind = met.schema["box"].dataType.simpleString()
        hits = seen.select(key, "us", "event_id").join(met.select("event_id", "box"), "event_id").select(key, "us", "event_id", "box")
        return batch.step("target", hits, key, ["us", "event_id"], point, {"box": None}, f"event_id bigint, box {kind}", f"box {kind}")

    return Steps(events, plan)


def run_through(stream: DataFrame | Steps, path: str, checkpoint: str) -> DataFrame:
    """Everything a stream emits for what is there now, as a table."""
    if isinstance(stream, Steps):
        return stream.run(path, checkpoint)
    query = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
