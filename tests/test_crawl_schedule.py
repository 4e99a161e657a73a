"""Politeness schedule against a step-by-step crawl, robots rules by prefix, trigram suggestions, seed files."""

import datetime as dt
import fnmatch
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import frontier, history, robots
from tidemark.sources.tables import read_seed_list, write_seed_lists

NOW = dt.datetime(2024, 1, 1, 12)
MS = dt.timedelta(milliseconds=1)


def simulated(queue, stats, horizon_ms, cap):
    """A crawler that looks at the clock every millisecond and takes, of each domain, its oldest url if the delay has passed."""
    waiting = {}
    for row in sorted(queue, key=lambda r: (r[3], r[0])):
        waiting.setdefault(row[1], []).append(row)
    out = []
    for domain, rows in waiting.items():
        crawled, fetched, delay, blocked = stats.get(domain, (0, None, None, False))
        now = NOW
        while rows and not blocked and now < NOW + horizon_ms * MS and crawled < cap:
            if fetched is None or fetched < now - (1000 if delay is None else delay) * MS:
                out.append((rows.pop(0)[0], now))
                fetched, crawled = now, crawled + 1
            now += MS
    return sorted(out)


def test_schedule_equals_a_simulation(spark):
    rnd = random.Random(6)
    domains = [f"d{i}.test" for i in range(12)]
    queue = [(i, rnd.choice(domains) if i % 2 else "hot.test", "pending" if i % 7 else "done", NOW - dt.timedelta(seconds=rnd.randrange(50))) for i in range(1, 200)]
    stats = {d: (rnd.randrange(4), rnd.choice([None, NOW - rnd.randrange(3000) * MS, NOW - 700 * MS]), rnd.choice([None, 0, 300, 700]), d == "d3.test") for d in [*domains[:9], "hot.test"]}
    stats["hot.test"] = (0, None, 5, False)
    q = spark.createDataFrame([(i, f"u{i}", d, 0, s, t, None, None) for i, d, s, t in queue],
                              "id long, url string, domain string, depth int, status string, discovered_at timestamp_ntz, processed_at timestamp_ntz, error string")
    ds = spark.createDataFrame([(d, *v) for d, v in stats.items()], "domain string, pages_crawled int, last_fetched_at timestamp_ntz, crawl_delay_ms int, disallowed boolean")
    as_of = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    pending = [r for r in queue if r[2] == "pending"]
    want = simulated(pending, stats, 1500, 5)
    full = frontier.fetch_schedule(q, ds, as_of, 1500, None, 5)
    assert sorted((r.id, r.fetch_at) for r in full.collect()) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # the hot domain lies in several ranges
        whole = frontier.fetch_schedule(q, ds, as_of, 1500)
        assert sorted((r.id, r.fetch_at) for r in whole.collect()) == simulated(pending, stats, 1500, 10**9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = frontier.fetch_schedule(q, ds, as_of, 1500, 7, 5).collect()
    found = {r[0]: r[3] for r in pending}
    assert sorted((r.id, r.fetch_at) for r in first) == sorted(sorted(want, key=lambda r: (r[1], found[r[0]], r[0]))[:7])


def test_patterns(spark):
    rnd = random.Random(3)
    patterns = ["/", "/a", "/a*", "/a$", "/*b$", "*", "*$", "/a**b", "/*/x*y$", "$", "/a.b", "/a*b*", "/[a]", "/a$b", "*a"]
    paths = ["/", "/a", "/ab", "/a.b", "/axb", "/a/x/y", "/b/xyxy", "/[a]", "/a$b"] + ["/" + "".join(rnd.choice("abxy/") for _ in range(6)) for _ in range(30)]

    def plain(path, pattern):
        anchored = pattern.endswith("$")
        rx = ".*".join(re.escape(p) for p in (pattern[:-1] if anchored else pattern).split("*"))
        return re.match(rx + ("$" if anchored else ""), path) is not None

    df = spark.createDataFrame([(p, t) for p in paths for t in patterns], "path string, pattern string")
    got = df.select("*", robots.pattern_matches(F.col("path"), F.col("pattern")).alias("m"), robots.literal_prefix(F.col("pattern")).alias("prefix")).collect()
    assert [(r.path, r.pattern) for r in got if r.m != plain(r.path, r.pattern)] == []
    assert all(r.path.startswith(r.prefix) for r in got if r.m)
    assert fnmatch.fnmatchcase("/a/x/y", "/*/x*y")


def test_ten_thousand_rules(spark):
    rules = "User-agent: *\n" + "".join(f"{'Allow' if i % 3 == 0 else 'Disallow'}: /p{i}/{'*.html$' if i % 50 == 0 else ''}\n" for i in range(10_000))
    cache = spark.createDataFrame([("x.test", rules, NOW)], "domain string, rules_text string, fetched_at timestamp_ntz")
    urls = ["/p1/a", "/p3/a", "/p50/a.html", "/p50/a.htm", "/p9999/", "/p10000/", "/", "/p150/x/y.html"]
    probes = spark.createDataFrame([(i, f"https://x.test{u}", "x.test", "Bot/1") for i, u in enumerate(urls)], "probe_id long, url string, domain string, agent string")
    got = [r.allowed for r in robots.check_permission(probes, cache).orderBy("probe_id").collect()]
    assert got == [False, True, False, True, True, True, True, True]


def test_trigram_suggestions_equal_the_join(spark):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "ALPHABET", "gamma ray", "ab", "a", "", "éclair", "abab"]
    rows = [(str(i), str(i % 4), rnd.choice(words) + rnd.choice(["", " 1", " x"]), NOW + i * MS) for i in range(200)]
    h = spark.createDataFrame(rows, "history_id string, user_id string, query string, ts timestamp_ntz")
    inputs = spark.createDataFrame([(str(u), t) for u in range(5) for t in [" ALP ", "bet", "ab", "a", "", "  ", "éCL", "abab", "zzz", "lpha 1"]], "user_id string, input string")
    columns = ["user_id", "input", "rank", "query"]
    found = history.indexed_suggestions(h, history.trigram_postings(h), inputs)
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, history.suggestions(h, inputs).select(columns).collect()))


def test_seed_files(spark, tmp_path):
    urls = [f"https://x.test/{i}?q=\"é\"" for i in range(25)]
    write_seed_lists(spark.createDataFrame([(u,) for u in [*urls, None]], "url string"), str(tmp_path / "seeds"), per_file=10)
    assert sorted(r.url for r in read_seed_list(spark, str(tmp_path / "seeds")).collect()) == sorted(urls)


def test_backup_of_all_kinds(spark, tmp_path):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {"settings": t([("1", "dark"), ("2", "light"), ("3", "x")], "user_id string, theme string"),
              "history": t([("1", "q1", NOW), ("2", "q2", NOW)], "user_id string, query string, ts timestamp_ntz"),
              "bookmarks": t([("2", "b")], "user_id string, id string"), "shortcuts": t([("1", "s1"), ("1", None)], "user_id string, shortcut_id string")}
    history.export_user_data(tables, str(tmp_path), t([("1",)], "user_id string"))
    out = history.restore_user_data(tables, str(tmp_path), t([("2", "1"), ("9", "1")], "user_id string, source_user string"))
    got = {k: sorted(tuple(r) for r in v.select("user_id", v.columns[1]).fillna("-").collect()) for k, v in out.items()}
    assert got == {"settings": [("1", "dark"), ("2", "dark"), ("3", "x"), ("9", "dark")], "history": [("1", "q1"), ("2", "q1"), ("9", "q1")],
                   "bookmarks": [], "shortcuts": [("1", "-"), ("1", "s1"), ("2", "-"), ("2", "s1"), ("9", "-"), ("9", "s1")]}
    assert out["history"].schema == tables["history"].schema
