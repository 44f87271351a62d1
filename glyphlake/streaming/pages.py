"""Streams of page reads: votes that grow pass by pass, and the direction in which a page is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators import pages
from glyphlake.operators.votes import vote, voted_lines
from glyphlake.streaming.steps import Batch, Steps

#: A read of fewer characters says nothing of a page's direction.
LEAST = 5


def vote_stream(passes: DataFrame, key: str, votes: int = 3, every: int = 1) -> Steps:
    """(key, event_id, vote, li, text, votes, conf): the lines of a page, voted anew with each pass that is admitted.

    ``passes`` has (key, us, event_id, page, glyphs): ``page`` tells that pixels and frame are the same as before,
    ``glyphs`` is an array of (li, ci, ch, x, y, w, h). The first pass of a page is admitted and is its base; of
    those that follow while the page stays, every ``every``-th that read at least half as many glyphs, ``votes`` in
    all. A row tells the vote over all passes admitted so far. Rows without a key are left out.

    State: the page, the ids of its admitted passes, the base's size and how long the page has stayed. Glyphs of
    admitted passes wait in a table of their own until the page turns.
    """
    state = "page string, ids array<bigint>, base int, stable int"

    def fold(memory, row):
        if not memory["ids"] or memory["page"] != row["page"]:
            ids = [row["event_id"]]
            return {"page": row["page"], "ids": ids, "base": row["n"], "stable": 0}, {"event_id": row["event_id"], "ids": ids}
        memory = memory | {"stable": memory["stable"] + 1}
        if len(memory["ids"]) < votes and memory["stable"] % every == 0 and row["n"] * 2 >= memory["base"]:
            memory = memory | {"ids": [*memory["ids"], row["event_id"]]}
            return memory, {"event_id": row["event_id"], "ids": memory["ids"]}
        return memory, None

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        rows = rows.where(F.col(key).isNotNull())
        size = F.coalesce(F.when(F.col("glyphs").isNotNull(), F.size("glyphs")), F.lit(0))
        events = rows.select(key, "us", "event_id", F.col("page").cast("string").alias("page"), size.alias("n"))
        told = batch.step("votes", events, key, ["us", "event_id"], fold, {"page": None, "ids": [], "base": 0, "stable": 0},
                          "event_id bigint, ids array<bigint>", state)
        now = rows.select(key, F.col("event_id").alias("id"), "glyphs")
        seen = batch.before("glyphs", now.schema).unionByName(now)
        held = batch.after().states("votes", rows.schema[key], state).select(key, F.explode("state.ids").alias("id"))
        batch.keep("glyphs", seen.join(held, [key, "id"], "left_semi").select(*now.columns))
        # A base's later passes only add to what was admitted, so its longest list has all that is asked for; its glyphs are met once.
        asked = told.groupBy(key, F.col("ids")[0].alias("_base")).agg(F.max_by("ids", F.size("ids")).alias("ids"))
        asked = asked.select(key, "_base", F.posexplode("ids").alias("pass", "id"))
        # Passes travel as they come and are spelled out where they are met.
        reads = asked.join(seen, [key, "id"]).repartition(F.col(key), F.col("_base")).select(key, "_base", "pass", F.inline("glyphs"))
        met = voted_lines(vote(reads, [key, "_base"], grown=True), [key, "_base", "vote"])
        # An event that came twice has the vote of its longer list.
        found = told.groupBy(key, "event_id", F.col("ids")[0].alias("_base")).agg(F.max(F.size("ids")).alias("_n"), F.collect_list(F.size("ids")).alias("_votes"))
        return met.withColumnRenamed("vote", "_n").join(found, [key, "_base", "_n"]).select(
            key, "event_id", "li", "text", "votes", "conf", F.explode("_votes").alias("vote"))

    return Steps(passes, plan)


def turn(state: str, row: dict) -> tuple[str, bool, bool]:
    """(state, is it upright, was it tried both ways) after a read.

    ``row`` has ``across``, the characters of the plain read, ``mostly_down``: its upright lines have more than twice
    those of the others, ``native_down``: it read upright columns as lines, ``fence``: it set single glyphs far
    apart, and ``turned``, the characters of the read of the turned page.
    """
    native = row["native_down"] and row["across"] >= LEAST
    if state == "horizontal":
        if native:
            return "vertical_native", True, False
        if row["across"] >= LEAST and not row["fence"] and not row["mostly_down"]:
            return state, False, False
    elif state == "vertical_native" and native:
        return state, True, False
    elif state == "vertical" and row["turned"] >= LEAST:
        return state, True, False
    # What was known no longer fits: both ways are tried.
    if native:
        return "vertical_native", True, True
    across = 0 if row["fence"] else row["across"]
    upright = row["turned"] > across * 2 and row["turned"] >= LEAST
    if across >= LEAST or row["turned"] >= LEAST:
        return ("vertical" if upright else "horizontal"), upright, True
    return "unknown", upright, True


def orientation(passes: DataFrame, key: str) -> Steps:
    """(key, event_id, state, upright, probed): which way each pass is read, by what was found before and what it shows itself.

    ``passes`` has (key, us, event_id, turned, lines, glyphs): ``lines`` an array of (n, w, h, down, cjk) and
    ``glyphs`` one of (li, ci, x, w, h) of the plain read, ``turned`` the characters that a read of the turned
    page finds. Event ids are unique. State: unknown, horizontal, vertical or vertical_native.
    """
    def fold(memory, row):
        state, upright, probed = turn(memory["state"], row)
        return {"state": state}, {"event_id": row["event_id"], "state": state, "upright": upright, "probed": probed}

    def plan(rows: DataFrame, batch: Batch) -> DataFrame:
        shown = pages.page_evidence(rows.select("event_id", F.inline("lines")), ["event_id"])
        fence = pages.picket_fence(rows.select("event_id", F.inline("glyphs")), ["event_id"], "li")
        no = F.lit(False)
        evidence = rows.select(key, "us", "event_id", F.coalesce("turned", F.lit(0)).cast("bigint").alias("turned")).join(
            shown, "event_id", "left").join(fence.select("event_id", "fence"), "event_id", "left").select(
            key, "us", "event_id", "turned", F.coalesce(F.col("n_across") + F.col("n_down"), F.lit(0)).cast("bigint").alias("across"),
            F.coalesce("mostly_down", no).alias("mostly_down"), F.coalesce(F.col("native_down") & ~F.col("rejected"), no).alias("native_down"),
            F.coalesce("fence", no).alias("fence"))
        return batch.step("direction", evidence, key, ["us", "event_id"], fold, {"state": "unknown"},
                          "event_id bigint, state string, upright boolean, probed boolean", "state string")

    return Steps(passes, plan)
