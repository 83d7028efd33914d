"""WARC archives and the URL filter."""

import hashlib
import math

import pytest
from pyspark.sql import types as T

from pyspark.sql import functions as F

from threadloom.llm import reputation, warc

PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("verdict", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGE)


def test_archives(spark, tmp_path):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", big), (5, "http://a/ 5\n", big), (3, None, big), (2, "u", small), (9, "u", small), (7, "u", None), (8, "u", ""), (None, "u", big), (4, "u", "z" * 1000), (None, "n", "q" * 2000), (11, "u", "r\r\n\r\nr" * 300), (12, "u", "w" * 5_000_000)]
    rows += [(5, "http://a/5b", big)]
    manifest = warc.write(frame(spark, rows), f"file://{tmp_path}/w")
    got = warc.read(manifest).toPandas()
    assert len(got) == len(rows) == sum(r["records"] for r in manifest.collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        group = [p for p, _, h in rows if h == html and len(data) >= 1000]
        keeper = max((p for p in group if p is not None), default=None)
        revisit = keeper is not None and page != keeper
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    clean = lambda v: None if v is None or v != v else v
    out = [tuple(clean(v) for v in r) for r in got[["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]].itertuples(index=False)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([(None if r[0] is None else int(r[0]), int(r[1]), r[2], r[3], None if r[4] is None else int(r[4])) for r in out], key=key) == sorted(want, key=key)
    assert all(p == hashlib.sha1(b).hexdigest() for p, b in zip(got["payload_digest"], got["payload"]) if b is not None)


def test_archive_form(spark, tmp_path):
    """A dictionary in a leading skippable frame, and one frame per record that can be read alone."""
    import struct

    import zstandard

    pages = [(i, f"http://h/{i}", f"<p>common words of every page, number {i}</p>" * 40) for i in range(300)]
    paths = [r["path"] for r in warc.write(frame(spark, pages).coalesce(1), f"file://{tmp_path}/f").collect()]
    data = open(paths[0], "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    rest, count = data[8 + size :], 0
    while rest:
        plain = zstandard.ZstdDecompressor(dict_data=words).decompressobj()
        one = plain.decompress(rest)
        assert one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")
        rest, count = plain.unused_data, count + 1
    assert count == 300


def test_damage_is_found(spark, tmp_path):
    manifest = warc.write(frame(spark, [(1, "u", "text")]), f"file://{tmp_path}/d")
    path = manifest.first()["path"]
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-6])
    with pytest.raises(Exception):
        warc.read(manifest).count()


def test_empty_archive(spark, tmp_path):
    assert warc.read(warc.write(frame(spark, []), f"file://{tmp_path}/e")).count() == 0


URLS = [
    (1, "http://A.example.NET/en/x?q", "a.example.net", "/en/x", "example.net/en/"), (2, "https://example.net", "example.net", "", None),
    (3, "https://example.net/", "example.net", "/", "net/"), (4, "x://b.example.com/de/1#f", "b.example.com", "/de/1", "example.com/de/"),
    (5, "x://notexample.com/de/1", "notexample.com", "/de/1", None), (6, "x://w.org/fr/", "w.org", "/fr/", "org/fr/"), (7, "x://borg/fr/", "borg", "/fr/", None),
    (8, None, "", "", None), (9, "no scheme", "", "", None), (10, "a://É.ORG?x=/fr/", "É.org", "", None), (11, "a://b://c/d", "b:", "//c/d", None), (12, "", "", "", None),
    (13, "a://example.net/fr/", "example.net", "/fr/", "net/"),
]


def test_rules(spark):
    pages = frame(spark, [(i, u, "") for i, u, *_ in URLS])
    none = pages.selectExpr("url", "1 as bad").where("false")
    got = {r["page_id"]: r for r in reputation.judge(pages, none).collect()}
    verdicts = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", None: "allow"}
    for i, _, host, path, rule in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, rule, verdicts[rule])


def test_reputation(spark):
    """Shrinking, level by level, by hand; few labels don't block and many do."""
    sites = {"bad.spam.com": (60, 58), "new.spam.com": (2, 2), "a.fine.com": (80, 4), "b.fine.com": (40, 1), "c.co.uk": (10, 1)}
    labelled = [(f"http://{h}/{i}", int(i < bad)) for h, (n, bad) in sites.items() for i in range(n)]
    table = spark.createDataFrame([*labelled, ("http://a.fine.com/", None)], "url string, bad int")
    pages = frame(spark, [(i, f"http://{h}/page", "") for i, h in enumerate([*sites, "x.spam.com", "y.other.com", "z.zz"])])
    got = {r["host"]: r for r in reputation.judge(pages, table).collect()}

    def strength(units, mean):
        n, k = sum(u[0] for u in units), len(units)
        p = sum(u[1] for u in units) / n
        s = sum(u[0] * (u[1] / u[0] - mean) ** 2 for u in units)
        between = (s - (k - 1) * p * (1 - p)) / (n - sum(u[0] ** 2 for u in units) / n) if k > 1 else 0
        return min(max((p * (1 - p) - between) / between, 1), 1000) if between > 0 else 1000

    def add(names):
        return tuple(map(sum, zip(*[sites[h] for h in names])))

    domains = {"spam.com": add(["bad.spam.com", "new.spam.com"]), "fine.com": add(["a.fine.com", "b.fine.com"]), "c.co.uk": sites["c.co.uk"]}
    suffixes = {"com": add([h for h in sites if h.endswith(".com")]), "co.uk": sites["c.co.uk"]}
    total = add(list(sites))
    mean = (total[1] + 0.5) / (total[0] + 1)
    w = [strength(list(u.values()), mean) for u in (suffixes, domains, sites)]
    com = (suffixes["com"][1] + w[0] * mean) / (suffixes["com"][0] + w[0])
    spam = (domains["spam.com"][1] + w[1] * com) / (domains["spam.com"][0] + w[1])
    bad = (58 + w[2] * spam) / (60 + w[2])
    assert math.isclose(got["bad.spam.com"]["bad_mean"], bad) and math.isclose(got["x.spam.com"]["bad_mean"], spam)
    assert math.isclose(got["y.other.com"]["bad_mean"], com) and math.isclose(got["z.zz"]["bad_mean"], mean)
    assert math.isclose(got["z.zz"]["bad_low"], mean - reputation.BOUND * math.sqrt(mean * (1 - mean) / (w[0] + 1)))
    low = bad - reputation.BOUND * math.sqrt(bad * (1 - bad) / (60 + w[2] + 1))
    assert math.isclose(got["bad.spam.com"]["bad_low"], low)
    assert got["bad.spam.com"]["verdict"] == "block" and got["a.fine.com"]["verdict"] == "allow" and got["z.zz"]["verdict"] == "allow"


def test_reputation_of_odd_tables(spark):
    """Empty tables, columns named like results, addresses and suffixes of two labels."""
    pages = frame(spark, [(1, None, ""), (2, "http://10.0.0.1:80/x", ""), (3, "http://a.b.gov.uk/", "")])
    table = spark.createDataFrame([], "url string, bad int")
    got = reputation.judge(pages.withColumn("verdict", F.lit("mine")).withColumn("bad_mean", F.lit(7)), table)
    assert {r["verdict"] for r in got.collect()} == {"allow"} and len(set(got.columns)) == len(got.columns)
    assert reputation.judge(pages.where("false"), table).count() == 0
    hosts = spark.createDataFrame([("10.0.0.1:80",), ("a.b.gov.uk",), ("x.y.co.nz",), ("a.example.com",), ("z",), ("",), ("a.b.own.tld",)], "host string")
    told = {r["host"]: (r["_domain"], r["_suffix"]) for r in hosts.withColumns(reputation.levels(suffixes=["own.tld"])).collect()}
    assert told == {
        "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "a.b.gov.uk": ("b.gov.uk", "gov.uk"), "x.y.co.nz": ("y.co.nz", "co.nz"), "a.example.com": ("example.com", "com"),
        "z": ("z", "z"), "": ("", ""), "a.b.own.tld": ("b.own.tld", "own.tld"),
    }
