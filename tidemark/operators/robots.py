"""Robots rules as table jobs (G1, G2, J9, W5, PF5, B8).

``rules_text`` of each domain is exploded to numbered lines; comments are cut, each line is split into a
lower-cased field and a value. A group starts at a ``user-agent`` line that does not follow another
``user-agent`` line; the group number is a running count over the lines of one domain (a window per
domain over one small file). Agent names are compared by their product token, lower-cased, without
version (``TestBot/1.0`` -> ``testbot``).

A probe (url, agent) uses the rules of every group naming its token, else those of ``*``; rules match
from the start of path + query, ``*`` is any run of characters and a trailing ``$`` anchors the end; the
longest pattern wins and allow wins a tie (RFC 9309); no matching rule means allowed. The crawl delay
is that of the same groups: a specific group wins outright, also when it states no delay. Of several cached
texts of a domain the latest counts.

A rule is keyed by its literal prefix, the part before the first ``*``. A probe looks up only those of its own prefixes whose length some rule of
its group has, by an equi-join (J9), so its work follows the number of distinct lengths and not the number of rules. What is
left of a pattern is matched piece by piece between its stars, with no regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CACHE_TTL_HOURS = 24


def agent_token(agent: Column) -> Column:
    return F.trim(F.lower(F.split_part(agent, F.lit("/"), F.lit(1))))


def rule_lines(robots: DataFrame) -> DataFrame:
    """(domain, line_no, field, value, group_id) for the non-empty lines of each rules text."""
    lines = robots.select(
        "domain", F.posexplode(F.split(F.coalesce(F.col("rules_text"), F.lit("")), r"\r\n|\r|\n")).alias("line_no", "raw")
    )
    body = F.trim(F.regexp_replace(F.col("raw"), "#.*$", ""))
    parsed = lines.select(
        "domain", "line_no",
        F.lower(F.trim(F.regexp_extract(body, r"^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_extract(body, r"^[^:]*:(.*)$", 1)).alias("value"),
    ).filter(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("domain").orderBy("line_no")
    prev = F.lag("field").over(w)
    start = ((F.col("field") == "user-agent") & (prev.isNull() | (prev != "user-agent"))).cast("int")
    marked = parsed.withColumn("_start", start)
    return marked.withColumn("group_id", F.sum("_start").over(w)).drop("_start")


def rule_tables(robots: DataFrame):
    """(agents: domain, group_id, agent), (rules: domain, group_id, allow, pattern), (delays: domain,
    group_id, line_no, delay_sec)."""
    lines = rule_lines(robots).filter(F.col("group_id") > 0)
    agents = lines.filter(F.col("field") == "user-agent").select(
        "domain", "group_id", agent_token(F.col("value")).alias("agent")).distinct()
    rules = lines.filter(F.col("field").isin("allow", "disallow") & (F.length("value") > 0)).select(
        "domain", "group_id", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    delays = lines.filter(F.col("field") == "crawl-delay").select(
        "domain", "group_id", "line_no", F.col("value").try_cast("double").alias("delay_sec"))
    return agents, rules, delays


def literal_prefix(pattern: Column) -> Column:
    """The part of a pattern before its first '*', without a '$' that ends it."""
    return F.when(F.contains(pattern, F.lit("*")), F.substring_index(pattern, "*", 1)).otherwise(F.regexp_replace(pattern, r"\$$", ""))


def pattern_matches(path: Column, pattern: Column) -> Column:
    """Whether a path matches a pattern from its start: each piece between stars at its first place after the one before."""
    anchored = F.endswith(pattern, F.lit("$"))
    pieces = F.split(F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern), r"\*", -1)
    first, last = F.get(pieces, 0), F.element_at(pieces, -1)

    def after(at: Column, piece: Column) -> Column:
        found = F.position(piece, path, at)
        return F.when((at == 0) | (F.length(piece) == 0), at).when(found == 0, F.lit(0)).otherwise(found + F.length(piece))

    free = F.when(anchored, F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))).otherwise(F.slice(pieces, F.lit(2), F.size(pieces)))
    end = F.aggregate(free, F.length(first) + 1, after)
    closed = F.when(F.size(pieces) == 1, path == first).otherwise(F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= end))
    return F.startswith(path, first) & (end > 0) & (~anchored | closed)


def url_path_query(url: Column) -> Column:
    pq = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.length(pq) == 0, F.lit("/")).when(pq.startswith("?"), F.concat(F.lit("/"), pq)).otherwise(pq)


def group_tables(robots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(domain, agent, lengths, delay_sec) per domain and named agent, and its rules (domain, agent, prefix, pattern, allow), from the latest text.

    ``lengths`` are the distinct lengths of the rules' literal prefixes.
    """
    agents, rules, delays = rule_tables(latest_rules(robots))
    named = agents.select("domain", "agent").distinct()
    own = rules.join(agents, ["domain", "group_id"]).select("domain", "agent", literal_prefix(F.col("pattern")).alias("prefix"), "pattern", "allow").distinct()
    lengths = own.groupBy("domain", "agent").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    delay = delays.join(agents, ["domain", "group_id"]).groupBy("domain", "agent").agg(
        F.max_by("delay_sec", "line_no").alias("delay_sec"))
    return named.join(lengths, ["domain", "agent"], "left").join(delay, ["domain", "agent"], "left"), own


def check_permission(probes: DataFrame, robots: DataFrame) -> DataFrame:
    """G1: probes (probe_id, url, domain, agent) -> (probe_id, allowed, crawl_delay_ms)."""
    groups, rules = group_tables(robots)
    p = probes.select("probe_id", "domain", agent_token(F.col("agent")).alias("agent"), url_path_query(F.col("url")).alias("path"))
    group = F.struct("agent", "lengths", "delay_sec")
    star = groups.filter(F.col("agent") == "*").select("domain", group.alias("star"))
    own = groups.select("domain", "agent", group.alias("own"))
    out = p.join(own, ["domain", "agent"], "left").join(star, "domain", "left")
    out = out.select("probe_id", "domain", "path", F.coalesce("own", "star").alias("group"))
    fits = F.filter("group.lengths", lambda n: n <= F.length("path"))
    looked_up = out.select("probe_id", "domain", F.col("group.agent").alias("agent"), "path", "group.delay_sec", F.explode_outer(fits).alias("n"))
    looked_up = looked_up.withColumn("prefix", F.left("path", F.col("n")))
    hits = looked_up.join(rules, ["domain", "agent", "prefix"], "left")
    counts = F.col("pattern").isNotNull() & pattern_matches(F.col("path"), F.col("pattern"))
    # the longest pattern wins, allow before disallow
    best = F.max(F.when(counts, F.struct(F.length("pattern").alias("chars"), "allow")))
    delay = F.max("delay_sec")
    return hits.groupBy("probe_id").agg(
        F.coalesce(best["allow"], F.lit(True)).alias("allowed"),
        F.when(delay > 0, (delay * 1000).cast("long")).alias("crawl_delay_ms"))


def latest_rules(robots: DataFrame) -> DataFrame:
    """The latest cached text of each domain; of texts fetched at one time, the largest."""
    key = F.struct(F.col("fetched_at"), F.coalesce(F.col("rules_text"), F.lit("")).alias("rules_text"))
    return robots.groupBy("domain").agg(F.max(key).alias("r")).select("domain", "r.rules_text", "r.fetched_at")


def cache_state(robots: DataFrame, as_of: Column) -> DataFrame:
    """G2 / PF5: latest rules row per domain, marked fresh (younger than 24 h) or stale (refetch)."""
    latest = latest_rules(robots)
    fresh = F.col("fetched_at") > as_of - F.expr(f"INTERVAL {CACHE_TTL_HOURS} HOURS")
    return latest.select("domain", "rules_text", "fetched_at",
                         F.when(fresh, F.lit("fresh")).otherwise(F.lit("stale")).alias("state"))
