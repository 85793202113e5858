"""URL filters by a temporal list join.

A list is a log of dated entries: a pattern was added or removed on a day. The log becomes validity intervals, one row
for each time that a pattern stood on the list, and an as-of join evaluates every capture against the entries that were
active on the day it was fetched.

A pattern without a slash is a host and holds for it and all hosts below it; one with a slash is a host and the start
of a path, up to a slash or to the end of the path. So a capture meets a list by equality of keys: the suffixes of its
host and the prefixes of its path, no deeper and no longer than the list's own patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed

#: Bytes of active entries (rows of the longest pattern's size) that are broadcast at most; more go by a salted shuffle.
BROADCAST_BYTES = 32 << 20
SALTS = 16
HOST = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host without user, port and trailing dots; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def path_of(url: Column) -> Column:
    """The path without query and fragment; / where it is empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    return F.when(path == "", "/").otherwise(path)


def keys_of(host: Column, path: Column, labels: int, depth: int, longest: int) -> Column:
    """All patterns that hold for a url, of at most ``labels`` labels or ``depth`` slashes, and ``longest`` characters."""
    label, step = F.split(host, r"\."), F.split(path, "/")
    n, m = F.least(F.size(label), F.lit(labels)), F.least(F.size(step) - 1, F.lit(depth))
    none = F.array().cast("array<string>")
    hosts = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(label, -i, i), "."))).otherwise(none)
    # A step of the path that no pattern is long enough for is cut, so that keys stay as short as the list's.
    short = F.transform(F.slice(step, 1, F.lit(depth + 1)), lambda s: F.substring(s, 1, longest + 1))
    starts = F.when(m > 0, F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(host, F.array_join(F.slice(short, F.lit(1), i), "/"), F.lit("/")))).otherwise(none)
    whole = F.when((F.size(step) - 1 <= depth) & ~path.endswith("/"), F.array(F.concat(host, F.substring(path, 1, longest + 1)))).otherwise(none)
    return F.when(host != "", F.filter(F.concat(hosts, starts, whole), lambda k: F.length(k) <= longest)).otherwise(none)


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (pattern, verdict, valid_from, valid_to): the stretches of days in which a pattern is listed, end excluded
    and null while it still is.

    ``entries`` has (pattern, verdict, day date, action); the action is add or remove. Entries with another action or a
    null are ignored. Repeated entries, an add while listed and a remove while not listed change nothing; of an add
    and a remove on one day the add counts. Patterns are lower-cased. An empty log gives no intervals. A window holds
    one row for each day of a pattern at most.
    """
    known = entries.where(F.col("action").isin("add", "remove") & F.col("pattern").isNotNull() & F.col("verdict").isNotNull() & F.col("day").isNotNull())
    host, slash = F.split_part(F.col("pattern"), F.lit("/"), F.lit(1)), F.instr("pattern", "/")
    pattern = F.when(slash > 0, F.concat(F.lower(host), F.expr("substring(pattern, instr(pattern, '/'))"))).otherwise(F.lower(host))
    states = known.select(pattern.alias("pattern"), "verdict", "day", (F.col("action") == "add").alias("listed")).groupBy("pattern", "verdict", "day").agg(F.max("listed").alias("listed"))
    w = W.partitionBy("pattern", "verdict").orderBy("day")
    changes = states.withColumn("before", F.coalesce(F.lag("listed").over(w), F.lit(False))).where("listed <> before")
    return changes.withColumn("valid_to", F.lead("day").over(w)).where("listed").select("pattern", "verdict", F.col("day").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetched_on", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (page_id, url, fetched_on, verdict, pattern, valid_from, n_active), one for each capture.

    Of the entries active on the day of the capture the most specific decides: one with a path before one without, then
    the longer pattern, then ``allow`` before others, then the greater verdict; n_active counts all of them. Without
    an active entry the verdict is ``allow`` and the pattern null; so it is for a null url and one without a host.
    A capture without a day has a null verdict. Repeated rows are kept; other columns are ignored; empty tables give
    no rows or no active entry. Scheme, user, port, query and fragment of a url are not looked at.

    Captures meet the intervals as distinct (key, day), so a host with a third of all captures is one row a day. What
    is active goes back to the captures by broadcast if it is small, else by a shuffle that splits each key in SALTS.
    """
    listed = checkpointed(intervals(entries))
    size = listed.agg(
        F.coalesce(F.max(F.when(~F.contains("pattern", F.lit("/")), F.size(F.split("pattern", r"\.")))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth"), F.coalesce(F.max(F.length("pattern")), F.lit(0)).alias("longest"),
    ).first()
    rows = checkpointed(captures.select(
        F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(day_col).cast("date").alias("fetched_on")
    ))
    keys = keys_of(host_of(F.col("url")), path_of(F.col("url")), size["labels"], size["depth"], size["longest"])
    keyed = rows.where("fetched_on is not null").select("row_key", F.col("fetched_on").alias("day"), F.explode(keys).alias("key"))

    asked = keyed.select("key", "day").distinct()
    holds = (F.col("key") == F.col("pattern")) & (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    active = checkpointed(asked.join(listed, holds).select("key", "day", "verdict", "valid_from"))

    if active.count() * (size["longest"] * 4 + 64) <= broadcast_bytes:
        met = keyed.join(F.broadcast(active), ["key", "day"])
    else:
        salt = F.pmod("row_key", F.lit(SALTS)).alias("salt")
        each = active.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        met = keyed.select("*", salt).join(each, ["key", "day", "salt"])
    # The largest struct is the most specific entry.
    rank = F.struct(F.contains("key", F.lit("/")).alias("path"), F.length("key").alias("n"), (F.col("verdict") == "allow").alias("allow"), F.col("verdict"), F.col("key"), F.col("valid_from"))
    best = met.groupBy("row_key").agg(F.max(rank).alias("best"), F.count("*").alias("n_active"))
    found = rows.join(best, "row_key", "left")
    verdict = F.when(F.col("fetched_on").isNotNull(), F.coalesce("best.verdict", F.lit("allow")))
    return found.select("page_id", "url", "fetched_on", verdict.alias("verdict"), F.col("best.key").alias("pattern"), F.col("best.valid_from").alias("valid_from"), F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"))
