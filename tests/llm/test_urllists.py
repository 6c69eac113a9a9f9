"""As-of judgement of captures against a plain evaluation of the entries' history."""

import datetime as dt
import random
import re

from callsight.llm import urllists

DAY0 = dt.date(2024, 1, 1)
ENTRY = "list string, kind string, pattern string, verdict string, action string, day date"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def brute(captures, entries):
    out = []
    for url, d in captures:
        m = re.match(urllists.URL, url or "")
        best = None
        if m and m[1] and d is not None:
            h = m[1].lower()
            parts = m[2].split("/")
            keys = {("url", h + m[2] + (m[3] or "")), ("host", h)}
            keys |= {("prefix", "/".join([h, *parts[1:k + 1]])) for k in range(1, len(parts))}
            labels = h.split(".")
            keys |= {("domain", ".".join(labels[-k:])) for k in range(2, len(labels) + 1)}
            for name, kind, pattern in {e[:3] for e in entries if None not in e}:
                if (kind, pattern) not in keys:
                    continue
                history = [e for e in entries if None not in e and e[:3] == (name, kind, pattern) and e[5] <= d]
                if not history:
                    continue
                last = max(e[5] for e in history)
                added = sorted(e[3] for e in history if e[5] == last and e[4] == "add")
                if added:
                    rank = (-urllists.KINDS[kind], -len(pattern), added[0], name, kind, pattern)
                    best = min(best or rank, rank)
        out.append((url, d, *((best[2], best[3], best[4], best[5]) if best else (None,) * 4)))
    return sorted(out, key=str)


def data():
    rng = random.Random(9)
    hosts = ["a.example.com", "b.example.com", "www.other.org", "solo"]
    paths = ["", "/", "/x", "/x/y", "/x/y/z?q=1", "/p#frag", "/x//y"]
    captures = [(f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice([h, h.upper()])}{rng.choice(['', ':8080'])}{rng.choice(paths)}",
                 day(rng.randrange(0, 500))) for h in hosts for _ in range(60)]
    captures += [(None, day(3)), ("", day(3)), ("not a url", day(3)), ("http://a.example.com/x", None), ("http:///x", day(1))] + captures[:2]
    patterns = [("host", h) for h in hosts] + [("domain", "example.com"), ("domain", "a.example.com"), ("domain", "other.org")]
    patterns += [("prefix", "a.example.com/x"), ("prefix", "b.example.com/x/y"), ("url", "a.example.com/x/y/z?q=1"), ("url", "solo/")]
    entries = [(rng.choice(["l1", "l2"]), *rng.choice(patterns), rng.choice(["block", "block", "allow"]), rng.choice(["add", "add", "remove"]),
                day(rng.randrange(-40, 600))) for _ in range(160)]
    entries += [("l1", "host", None, "block", "add", day(0)), ("l1", "host", "solo", "block", "add", None)] + entries[:3]
    return captures, entries


def test_as_of(spark):
    captures, entries = data()
    frame = spark.createDataFrame([(u, d, "own", 1) for u, d in captures], "url string, day date, verdict string, row int")
    got = urllists.judge(frame, spark.createDataFrame(entries, ENTRY))
    rows = [(r["capture"]["url"], r["capture"]["day"], r["verdict"], r["list"], r["kind"], r["pattern"]) for r in got.collect()]
    want = brute(captures, entries)
    assert sorted(rows, key=str) == want
    assert sum(w[2] is not None for w in want) > 100
    kept = urllists.filtered(frame, spark.createDataFrame(entries, ENTRY))
    assert kept.columns == frame.columns and kept.count() == sum(w[2] != "block" for w in want)


def test_empty_tables(spark):
    captures, entries = data()
    frame = spark.createDataFrame(captures, "url string, day date")
    none = spark.createDataFrame([], ENTRY)
    assert urllists.judge(frame, none).where("verdict is null").count() == len(captures)
    assert urllists.judge(frame.limit(0), spark.createDataFrame(entries, ENTRY)).count() == 0


def test_prefixes_of_a_host_and_with_a_slash(spark):
    entries = spark.createDataFrame([
        ("p", "prefix", "a.example", "block", "add", "2024-01-01"), ("p", "prefix", "b.example/p/", "block", "add", "2024-01-01"),
        ("p", "prefix", "a.example/ok//", "allow", "add", "2024-01-01"), ("p", "prefix", "c.example/", "block", "add", "2024-01-01")],
        "list string, kind string, pattern string, verdict string, action string, day string")
    urls = {"http://a.example": "block", "http://a.example/": "block", "http://a.example/x/y": "block", "http://a.example/ok": "allow",
            "http://a.example/ok/z": "allow", "http://a.example/okay": "block", "http://b.example/p": "block", "http://b.example/p/q/r": "block",
            "http://b.example/pq": None, "http://b.example/": None, "http://c.example/any": "block", "http://sub.a.example/": None}
    captures = spark.createDataFrame([(u, "2024-02-01") for u in urls], "url string, day string")
    got = {r["capture"]["url"]: r["verdict"] for r in urllists.judge(captures, entries).collect()}
    assert got == urls
