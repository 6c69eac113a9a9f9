"""URL lists over time: every capture is judged by the list entries in force on its date.

Dated entries (list, kind, pattern, verdict, action, day) become validity intervals: an entry holds from
the day it is added until the day of the next entry for the same pattern; of several on one day, an
addition counts before a removal and ``allow`` before ``block``. Captures are matched as of their day by
equi-joins on the keys that a URL has (itself, its path prefixes, its host and the domains above) and the
calendar month, so neither a key with a long history nor a host with many captures pairs everything.

The most specific match decides: url, then the longest prefix, host, the longest domain; at equal rank
``allow``, then the first list by name. A prefix is a host, or a host and whole path segments; a slash at its end
says nothing. Keys have no scheme, user, port or fragment and a lower-case host.
Defined cases: a null, empty or hostless URL, or a capture without a day, matches nothing and has no
verdict; entries with a null field are ignored; repeated captures are judged each; without entries
nothing matches; captures keep their other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
KINDS = {"url": 4, "prefix": 3, "host": 2, "domain": 1}


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, pattern, verdict, since, until (exclusive; null while it still holds)."""
    fields = ["list", "kind", "pattern", "verdict", "action", "day"]
    # a prefix names a host or a folder, with or without a slash at its end
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace("pattern", "/+$", "")).otherwise(F.col("pattern"))
    daily = (entries.withColumn("pattern", pattern).select(*fields[:-1], F.col("day").cast("date").alias("day")).dropna()
             .groupBy("list", "kind", "pattern", "day")
             .agg(F.max(F.col("action") == "add").alias("added"),
                  F.min(F.when(F.col("action") == "add", F.col("verdict"))).alias("verdict")))
    after = F.lead("day").over(Window.partitionBy("list", "kind", "pattern").orderBy("day"))
    return (daily.withColumn("until", after).where("added")
            .select("list", "kind", "pattern", "verdict", F.col("day").alias("since"), "until"))


def _keys(rows: DataFrame, depths: list[int]) -> DataFrame:
    """row, day, kind and key for every key of a capture's URL. depths: of the path prefixes that lists name."""
    url, path = F.col("url"), F.regexp_extract("url", URL, 2)
    rows = rows.select("row", "day", host(url).alias("host"), F.split(path, "/").alias("parts"),
                       F.concat(host(url), path, F.regexp_extract("url", URL, 3)).alias("whole")).where("host != ''")
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
                          lambda n: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, -n, n), ".").alias("key")))
    prefixes = [F.when(F.size("parts") > d, F.struct(F.lit("prefix").alias("kind"), F.concat_ws(
        "/", "host", F.array_join(F.slice("parts", 2, d), "/")).alias("key"))) if d else
        F.struct(F.lit("prefix").alias("kind"), F.col("host").alias("key")) for d in depths]
    own = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("url", "whole"), ("host", "host"))]
    all_ = F.concat(F.array(*own, *prefixes), F.when(F.size(labels) >= 2, domains).otherwise(F.slice(domains, 1, 0)))
    return rows.select("row", "day", F.explode(all_).alias("k")).where("k is not null").select("row", "day", "k.kind", "k.key")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures with verdict, list, kind and pattern of the entry that decides (null without one).

    Where captures have columns of these names, theirs are kept in ``capture`` and come out unchanged there.
    """
    rows = stage(captures.select(F.monotonically_increasing_id().alias("row"), F.col(url).alias("url"),
                                 F.col(day).cast("date").alias("day"),
                                 F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("capture")), "url-captures")
    periods = stage(intervals(entries), "url-intervals")
    last = rows.agg(F.max("day")).first()[0]
    depths = sorted(r[0] for r in periods.where("kind = 'prefix'")
                    .select((F.size(F.split("pattern", "/")) - 1).alias("depth")).distinct().collect())
    if last is None:
        last = F.lit(None).cast("date")
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    monthly = (periods.withColumn("end", end).where("end >= since")
               .withColumn("month", F.explode(F.expr("sequence(trunc(since, 'MM'), trunc(end, 'MM'), interval 1 month)"))))
    keys = _keys(rows.where("url is not null and day is not null"), depths).withColumn("month", F.trunc("day", "MM"))
    rank = F.create_map(*[x for k, n in KINDS.items() for x in (F.lit(k), F.lit(n))])
    # the lists' size has no bound, and a written table compresses far below its size: no broadcast
    found = (keys.join(monthly.withColumnRenamed("pattern", "key").hint("merge"), ["kind", "key", "month"])
             .where(F.col("day").between(F.col("since"), F.col("end")))
             .groupBy("row").agg(F.min(F.struct((-rank[F.col("kind")]).alias("rank"), (-F.length("key")).alias("length"),
                                                "verdict", "list", "kind", F.col("key").alias("pattern"))).alias("m")))
    return rows.join(found.hint("merge"), "row", "left").select("capture", "m.verdict", "m.list", "m.kind", "m.pattern")


def filtered(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures that no entry in force blocks, with all their columns."""
    return judge(captures, entries, url, day).where("verdict is null or verdict != 'block'").select("capture.*")
