"""Hosts as browsers write them, against Python's own codecs."""

import ipaddress
import random

from pyspark.sql import functions as F

from tidemark.functions.hosts import canonical_host, ipv6, punycode
from tidemark.functions.urls import add_normalized_url, get_domain


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_punycode_equals_the_codec(spark):
    rnd = random.Random(8)
    alphabets = ["abcü", "äöü", "例え漢字", "абв", "a-1é", "😀z", "ςßñ", "العربية"]
    labels = ["".join(rnd.choice(a) for _ in range(rnd.randrange(1, 25))) for a in alphabets for _ in range(25)] + ["plain", "", "x" * 60 + "é", "é" * 50]
    want = [t if t.isascii() else "xn--" + t.encode("punycode").decode() for t in labels]
    assert values(spark, punycode, labels) == want


def test_ipv6_equals_the_library(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(150):
        groups = [rnd.choice([0, 0, 0, rnd.randrange(65536)]) for _ in range(8)]
        full = ":".join(rnd.choice(["%x", "%04X"]) % g for g in groups)
        texts += [full, ipaddress.IPv6Address(full).compressed]
    texts += ["::", "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7.8.9.10", "::1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::12345", "g::", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "1:2:3:4:5:6:7:8::", "1.2.3.4", "::1%eth0", ":1::", "1:"]

    def plain(t):
        packed = ipaddress.IPv6Address(t).packed
        groups = [packed[k] * 256 + packed[k + 1] for k in range(0, 16, 2)]
        runs = sorted(((k, -i) for i in range(8) for k in range(2, 9 - i) if not any(groups[i : i + k])), reverse=True)
        short = [f"{g:x}" for g in groups]
        if not runs:
            return ":".join(short)
        k, i = runs[0][0], -runs[0][1]
        return ":".join(short[:i]) + "::" + ":".join(short[i + k :])

    assert values(spark, ipv6, texts) == [plain(t) for t in texts]
    assert values(spark, ipv6, bad) == [None] * len(bad)


def test_hosts(spark):
    cases = {
        "plain.test": "plain.test", "a_b.test.": "a_b.test.", "müller.de": "xn--mller-kva.de", "0x7f.1": "127.0.0.1", "1": "0.0.0.1", "0": "0.0.0.0",
        "256": "0.0.1.0", "4294967295": "255.255.255.255", "4294967296": None, "1.2.3": "1.2.0.3", "1.2.65536": None, "1.2.3.4.": "1.2.3.4", "1.2.3.4.5": None,
        "09.1": None, "08": None, "0x": "0.0.0.0", "0xg.test": "0xg.test", "1.0xzz": "1.0xzz", "a.1": None, "1..2": None, "99999999999999999999": None, "%": None, "a%20b": None, "a b": None,
        "ex%61mple.org": "example.org", "%C3%BC.de": "xn--tda.de", "a+b.test": "a+b.test", "[::1]": "[::1]", "[1.2.3.4]": None, "[": None, "a]b": None,
        "ＷＷＷ．test": "www.test", "so­ft.test": "soft.test", "": None, "a|b": None, "xn--mller-kva.de": "xn--mller-kva.de",
    }
    assert dict(zip(cases, values(spark, canonical_host, [k.lower() for k in cases]), strict=True)) == cases


def test_urls_with_hosts(spark):
    cases = [
        ("http://müller.de/ü", None, "http://xn--mller-kva.de/%C3%BC", "xn--mller-kva.de"), ("http://[::1]:80/x", None, "http://[::1]/x", "[::1]"),
        ("https://[2001:DB8:0:0:1:0:0:1]/x", None, "https://[2001:db8::1:0:0:1]/x", "[2001:db8::1:0:0:1]"), ("https://[::1]:80/x", None, "https://[::1]:80/x", "[::1]"), ("http:x", "http://h.test/a/b", "http://h.test/a/x", "h.test"),
        ("http:x", "https://h.test/a/b", "http://x/", "x"), ("http:x", None, "http://x/", "x"), ("HTTP:/x", "http://h.test/a/b", "http://h.test/x", "h.test"),
        ("http:\\\\o.test/x", "http://h.test/a", "http://o.test/x", "o.test"), ("/\\o.test/x", "http://h.test/a", "http://o.test/x", "o.test"),
        ("http:?q=1", "http://h.test/a/b", "http://h.test/a/b?q=1", "h.test"), ("http:", "http://h.test/a/b?c=1", "http://h.test/a/b?c=1", "h.test"),
        ("http://0x7f.1:8080/", None, "http://127.0.0.1:8080/", "127.0.0.1"), ("http://u:p@[1::]:99999/", None, None, None), ("http://[::1/", None, None, None),
    ]
    df = spark.createDataFrame(cases, "h string, b string, url string, domain string")
    got = add_normalized_url(df, "h", "b", "got").withColumn("got_domain", get_domain(F.col("got"))).collect()
    assert [(r.h, r.got, r.got_domain) for r in got] == [(r.h, r.url, r.domain) for r in got]
