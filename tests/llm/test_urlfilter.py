"""URL filters against a loop over all captures and the whole log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import urlfilter

CAPTURES, ENTRIES = "page_id long, url string, fetched_on date", "pattern string, verdict string, day date, action string"
DAY = dt.date(2024, 1, 1)
day = lambda k: DAY + dt.timedelta(days=k)


def split(url):
    rest = (url or "").strip().partition("://")[2]
    place = rest.split("#")[0].split("?")[0]
    host, slash, path = place.partition("/")
    return host.rpartition("@")[2].split(":")[0].lower().rstrip("."), "/" + path if slash else "/"


def brute(url, when, log):
    if when is None:
        return None, None, None, 0
    host, path = split(url)
    rules = {(p.lower() if "/" not in p else p.partition("/")[0].lower() + "/" + p.partition("/")[2], v) for p, v, d, a in log if None not in (p, v, d) and a in ("add", "remove")}
    active = []
    for p, v in rules:
        mine = {}
        for q, w, d, a in log:
            if None not in (q, w, d) and a in ("add", "remove") and w == v and (q.lower() == p if "/" not in q else q.partition("/")[0].lower() + "/" + q.partition("/")[2] == p):
                mine[d] = mine.get(d, False) or a == "add"
        listed, since = False, None
        for d in sorted(mine):
            if d <= when and mine[d] != listed:
                listed, since = mine[d], d
        holds = host and (((p.endswith("/") and (host + path).startswith(p)) or host + path == p) if "/" in p else host == p or host.endswith("." + p))
        if listed and holds:
            active.append(("/" in p, len(p), v == "allow", v, p, since))
    best = max(active) if active else None
    return (best[3], best[4], best[5], len(active)) if best else ("allow", None, None, 0)


def log_of(rnd):
    patterns = ["a.org", "b.a.org", "org", "A.org/x/", "a.org/x/y", "a.org/", "c.net", "b.a.org/x/y/z/", "c.net/Q/"]
    log = [(rnd.choice(patterns), rnd.choice(["block", "block", "allow", "watch"]), day(rnd.randint(0, 40)), rnd.choice(["add", "add", "remove"])) for _ in range(70)]
    return log + log[:10] + [(None, "block", DAY, "add"), ("org", None, DAY, "add"), ("org", "block", None, "add"), ("a.org", "block", DAY, "drop"), ("a.org", "block", DAY, None)]


def captures_of(rnd):
    urls = [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'u:p@'])}{rnd.choice(['a.org', 'B.A.org', 'x.b.a.org.', 'c.net', 'ca.org', 'org'])}{rnd.choice(['', ':80'])}{rnd.choice(['', '/', '/x', '/x/', '/x/y', '/x/y/z/w', '/Q/q', '/q/'])}{rnd.choice(['', '?a=/x/', '#b'])}" for _ in range(120)]
    urls += [None, "", "no host", "://", "https://" + "a." * 300 + "org/" + "x/" * 3000, "https://a.org/x/" + "y" * 50_000]
    rows = [(k, u, day(rnd.randint(-3, 45))) for k, u in enumerate(urls)]
    return rows + rows[:7] + [(None, urls[0], DAY), (900, urls[1], None)]


@pytest.mark.parametrize(("seed", "most"), [(1, 1 << 20), (2, 0)])
def test_verdicts_equal_a_loop_by_broadcast_and_by_shuffle(spark, seed, most):
    rnd = random.Random(seed)
    log, rows = log_of(rnd), captures_of(rnd)
    captures = spark.createDataFrame(rows, CAPTURES).repartition(3)
    for c in ("row_key", "key", "day", "verdict", "pattern", "valid_from", "n_active", "best", "salt", "host"):
        captures = captures.withColumn(c, F.lit(1))
    got = urlfilter.judged(captures, spark.createDataFrame(log, ENTRIES).withColumn("listed", F.lit(0)), broadcast_bytes=most)
    want = sorted(str((i, u, d, *brute(u, d, log))) for i, u, d in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_intervals(spark):
    log = [("x.org", "block", day(k), a) for k, a in ((5, "add"), (7, "add"), (9, "remove"), (9, "remove"), (9, "add"), (12, "remove"), (13, "remove"), (20, "add"))]
    got = urlfilter.intervals(spark.createDataFrame(log, ENTRIES)).orderBy("valid_from").collect()
    assert [(r["valid_from"], r["valid_to"]) for r in got] == [(day(5), day(12)), (day(20), None)]


def test_empty_tables(spark):
    captures, none = spark.createDataFrame([(1, "https://a.org/", DAY)], CAPTURES), spark.createDataFrame([], ENTRIES)
    assert [tuple(r)[3:] for r in urlfilter.judged(captures, none).collect()] == [("allow", None, None, 0)]
    assert urlfilter.judged(captures.limit(0), spark.createDataFrame([("a.org", "block", DAY, "add")], ENTRIES)).collect() == []
