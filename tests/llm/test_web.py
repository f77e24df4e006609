from datetime import date, datetime, timedelta

import pytest

from frostgrid.llm.revisits import resolve_revisits
from frostgrid.llm.url_filters import filter_captures
from frostgrid.llm.urls import canonical_url, host_of


@pytest.mark.parametrize(
    "url,canonical,host",
    [
        ("HTTP://User@Www.Example.COM:80?q=A#f", "http://www.example.com/?q=A", "www.example.com"),
        ("https://a.b:443/x#y", "https://a.b/x", "a.b"), ("https://a.b.:80/X", "https://a.b.:80/X", "a.b"),
        ("no url", "no url", None), ("", "", None), (None, None, None), ("ftp://h/p?x#z", "ftp://h/p?x", "h"),
    ],
)
def test_urls(spark, url, canonical, host):
    df = spark.createDataFrame([(url,)], "u string").select(canonical_url("u").alias("c"), host_of("u").alias("h"))
    assert tuple(df.collect()[0]) == (canonical, host)


def day(n):
    return None if n is None else date(2024, 1, 1) + timedelta(days=n)


def plain_filter(captures, entries):
    """Captures are (id, url, canonical, host, day)."""
    out = []
    for i, _, canonical, host, n in captures:
        found = set()
        for name, allow in {(e[0], bool(e[1])) for e in entries if e[0]}:
            for key in {e[2] for e in entries if e[2]}:
                names = key == canonical or host is not None and (host == key or host.endswith("." + key))
                past = [e for e in entries if (e[0], bool(e[1])) == (name, allow) and e[2] == key and None not in (e[3], e[4])]
                past = [e for e in past if n is not None and e[3] <= n]
                if names and past and all(e[4] for e in past if e[3] == max(x[3] for x in past)):
                    found.add((name, allow))
        out.append((i, host, sorted({name for name, _ in found}), bool(found) and not any(a for _, a in found)))
    return sorted(out, key=repr)


CAPTURES = [
    (1, "http://a.b.c/x", "http://a.b.c/x", "a.b.c", 3), (1, "http://a.b.c/x", "http://a.b.c/x", "a.b.c", 3),
    (2, "http://A.B.C/x#1", "http://a.b.c/x", "a.b.c", 5), (3, "http://b.c/", "http://b.c/", "b.c", 5),
    (4, None, None, None, 5), (5, "http://b.c/", "http://b.c/", "b.c", None), (6, "junk", "junk", None, 5),
    (7, "http://xb.c/", "http://xb.c/", "xb.c", 9), (None, "http://b.c/", "http://b.c/", "b.c", 20),
    (8, "http://a.b.c/" + "y" * 20000, "http://a.b.c/" + "y" * 20000, "a.b.c", 9), (9, "http://z.z/", "http://z.z/", "z.z", 0),
]
ENTRIES = [
    ("bad", False, "b.c", 4, True), ("bad", False, "b.c", 4, True), ("bad", False, "b.c", 8, False), ("bad", False, "b.c", 9, True),
    ("bad", False, "b.c", 9, False), ("worse", None, "c", 5, True), ("worse", None, "c", 9, True), ("good", True, "a.b.c", 5, True),
    ("good", True, "a.b.c", 6, False), ("urls", False, "http://a.b.c/x", 0, True), (None, False, "b.c", 0, True),
    ("bad", False, None, 0, True), ("bad", False, "b.c", None, True), ("bad", False, "z.z", 0, None), ("urls", False, "junk", 0, True),
]


@pytest.mark.parametrize("rows_for_broadcast", [10_000, 0])
def test_filters(spark, monkeypatch, rows_for_broadcast):
    monkeypatch.setattr("frostgrid.llm.common.BROADCAST_ROWS", rows_for_broadcast)
    captures = spark.createDataFrame(
        [(i, u, day(n), "l", 0) for i, u, _, _, n in CAPTURES], "page_id bigint, url string, day date, lists string, host int"
    )
    entries = spark.createDataFrame(
        [(a, b, c, day(d), e, "x") for a, b, c, d, e in ENTRIES],
        "list string, allow boolean, key string, day date, listed boolean, host string",
    )
    got = filter_captures(captures, entries, "page_id")
    wanted = plain_filter(CAPTURES, [e for e in ENTRIES if e[2] != "junk"])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted
    nothing = filter_captures(captures, entries.where("false"), "page_id").collect()
    assert len(nothing) == len(CAPTURES) and not any(r.blocked or r.lists for r in nothing)
    assert filter_captures(captures.where("false"), entries, "page_id").count() == 0


RECORDS = "record_id bigint, url string, fetched timestamp, kind string, status int, headers map<string,string>, payload_digest string, answer int"


def at(h):
    return None if h is None else datetime(2024, 1, 1) + timedelta(minutes=20 * h)


def plain_revisits(rows):
    permitted = {"cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"}
    lower = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    bare = lambda u: None if u is None else u.split("#")[0]
    out = []
    for i, url, t, kind, _, headers, _ in rows:
        if kind != "revisit":
            continue
        own = lower(headers)
        before = [
            (r[2], r[0], r) for r in rows
            if r[3] == "response" and r[4] == 200 and None not in (r[1], r[2], url, t) and bare(r[1]) == bare(url) and r[2] < t
        ]
        if not before:
            out.append((i, bare(url), "no response", None, None, own))
            continue
        of = max(before, key=lambda b: b[:2])[2]
        theirs = lower(of[5])
        tag = lambda h: h.get("etag") and h["etag"].removeprefix("W/")
        if tag(own) and tag(theirs):
            differ = tag(own) != tag(theirs)
        else:
            differ = bool(own.get("last-modified") and theirs.get("last-modified") and own["last-modified"] != theirs["last-modified"])
        merged = {**theirs, **{k: v for k, v in own.items() if k in permitted}}
        out.append((i, bare(url), "mismatch", of[0], None, own) if differ else (i, bare(url), "resolved", of[0], of[6], merged))
    return sorted(out, key=repr)


def test_revisits(spark):
    rows = [
        (1, "http://a.b/", 0, "response", 200, {"ETag": "x", "Content-Type": "t"}, "d1"),
        (2, "http://a.b/", 0, "response", 200, {"etag": "y"}, "d2"), (3, "http://a.b/", 1, "response", 404, {"etag": "z"}, "d3"),
        (4, "http://a.b/", 0, "revisit", 304, {"etag": "x"}, None), (5, "http://a.b/#f", 1, "revisit", 304, {"ETAG": "W/y", "Date": "n"}, None),
        (6, "http://a.b/", 400, "revisit", 304, {"etag": "q"}, None), (6, "http://a.b/", 400, "revisit", 304, {"etag": "q"}, None),
        (7, None, 5, "revisit", 304, None, None), (8, "http://a.b/", None, "revisit", 304, {}, None), (9, "http://c/", 5, "revisit", 304, None, None),
        (10, "http://d/", 3, "response", 200, {"last-modified": "m", "content-length": "9"}, "d10"),
        (11, "http://d/", 9, "revisit", 304, {"last-modified": "m", "content-length": "0", "vary": "v"}, None),
        (12, "http://d/", 9, "revisit", 304, {"last-modified": "o"}, None), (13, "http://d/", 9, "revisit", 304, None, None),
        (None, "http://d/", 900, "revisit", 304, {"etag": "x"}, None), (14, "http://d/", None, "response", 200, None, "d14"),
        (15, "http://d/", 950, "response", None, None, "d15"), (16, "http://d/", 960, None, 200, None, "d16"),
    ]
    rows += [(100 + i, "http://hot/", i * 7 % 50, "revisit" if i % 3 else "response", 200, {"etag": str(i % 2)}, f"h{i}") for i in range(200)]
    rows = [(a, b, at(c), *rest) for a, b, c, *rest in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], RECORDS)
    for cell in (3600, 60):
        got = [tuple(r) for r in resolve_revisits(df, cell).select("record_id", "url", "outcome", "refers_to", "payload_digest", "headers").collect()]
        assert sorted(got, key=repr) != [] and sorted(map(norm, got), key=repr) == sorted(map(norm, plain_revisits(rows)), key=repr)
    assert resolve_revisits(df.where("false")).count() == 0


def norm(row):
    return (*row[:-1], sorted(row[-1].items()))
