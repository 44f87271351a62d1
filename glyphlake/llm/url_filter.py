"""URL filter: rules by host and path, and a list of URLs behind a blocked Bloom filter.

Every canonical URL of the list sets one bit in each of the eight words of one
block. The filter has a fixed number of blocks, so what is broadcast has the same
size for any list; a longer list only lets more URLs through to the exact join
that follows, which removes every false positive. Only URLs that the filter lets
through are shuffled.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"


@dataclass(frozen=True)
class Rule:
    """``action`` for ``host``, its subdomains, and paths that start with ``path``."""

    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://(.*)$", 1)
    return (_lower(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
            F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1))


def canonical_url(url: Column) -> Column:
    """Host without www. or m., path without its last slashes, sorted query without tracking; null without host."""
    host, path, query = url_parts(url)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    bare = F.concat(F.regexp_replace(host, "^(www|m)[.]", ""), F.regexp_replace(path, "/+$", ""))
    return F.when(host != "", F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                                       .otherwise("")))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits (ties: the smaller text), else null."""
    text = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def _place(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks)).cast("int")


def _bits(canonical: Column) -> list[Column]:
    second = F.xxhash64(canonical, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.call_function("shiftrightunsigned", second, F.lit(6 * i)).bitwiseAND(63).cast("int"))
            for i in range(WORDS)]


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): at most ``blocks`` rows of 512 bits for a table with a ``canonical`` column."""
    bits = listed.select(_place(F.col("canonical"), blocks).alias("block"),
                         *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    return bits.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), blocks: int = 65_536,
                page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, listed): one row per row of ``pages``.

    The verdict is the action of the longest fitting rule; without one, ``block``
    if the canonical URL is on the list, else ``allow``. Null URLs and URLs
    without ``://`` have empty host and path and are allowed. Repeated rows are
    judged each; other columns are not carried. Null entries of the list and
    repeats in it change nothing; an empty list blocks nothing. ``blocks`` bounds
    the broadcast: 64 bytes for each.
    """
    exact = (listed.select(canonical_url(F.col(listed_url)).alias("canonical"))
             .where(F.col("canonical").isNotNull()).distinct())
    host, path, _ = url_parts(F.col("url"))
    rule, action = rule_for(F.col("host"), F.col("path"), rules)
    probe = (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
             .select("page_id", host.alias("host"), path.alias("path"), canonical_url(F.col("url")).alias("canonical"))
             .withColumns({"rule": rule, "action": action, "block": _place(F.col("canonical"), blocks)})
             .join(F.broadcast(bloom_filter(exact, blocks)), "block", "left"))
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        passes &= F.col(f"w{i}").bitwiseAND(bit) != 0
    probe = probe.withColumn("possible", F.coalesce(passes & F.col("canonical").isNotNull(), F.lit(False)))
    keep = ["page_id", "host", "path", "rule", "action", "canonical"]
    ruled_out = probe.where(~F.col("possible")).select(*keep, F.lit(False).alias("listed"))
    checked = (probe.where("possible").select(*keep)
               .join(exact.withColumn("hit", F.lit(True)), "canonical", "left")
               .select(*keep, F.coalesce("hit", F.lit(False)).alias("listed")))
    return ruled_out.unionByName(checked).select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical", "listed")
