"""robots.txt rules as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import strip
from pagemill.functions.urls import origin, path_and_query

AGENT = "pagemill/1.0"
BLOCKED = "Blocked by robots.txt"

# Line ends and the fields that make a rule line.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_RULE_FIELDS = ["disallow", "allow", "crawl-delay", "request-rate"]


def percent_decode(text: Column) -> Column:
    """Decode ``%xx``; a percent sign without two hex digits stays, and so does a plus."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(safe), text)).otherwise(text)


def robots_policy(bodies: DataFrame) -> DataFrame:
    """What the answer to the robots request means: ``origin, policy``.

    Unreachable or unreadable allows everything, 401 and 403 deny everything, other 4xx allow
    everything, and any other failure leaves nothing allowed.
    """
    status = F.col("http_status")
    return bodies.select(
        "origin",
        F.when(status.isNull(), F.lit("allow_all"))
        .when(status.between(200, 299) & F.col("body").isNull(), F.lit("allow_all"))
        .when(status.between(200, 299), F.lit("rules"))
        .when(status.isin(401, 403), F.lit("deny_all"))
        .when(status.between(400, 499), F.lit("allow_all"))
        .otherwise(F.lit("deny_all"))
        .alias("policy"),
    )


def parse_robots(bodies: DataFrame) -> DataFrame:
    """Rules of every readable body: ``origin, entry_no, agents, rule_no, path, allow``.

    An entry starts at a user-agent line that does not follow another one, and ends at an empty
    line; it counts only with a rule line in it.  ``path`` is NULL for an entry whose only rule
    lines are delays.
    """
    file = Window.partitionBy("origin").orderBy("line_no")
    upto = file.rowsBetween(Window.unboundedPreceding, 0)
    lines = bodies.where(F.col("http_status").between(200, 299) & F.col("body").isNotNull()).select(
        "origin", F.posexplode(F.split("body", _LINE_END)).alias("line_no", "line")
    )
    text = strip(F.regexp_replace("line", "(?s)#.*", ""))
    events = (
        lines.withColumn("text", text)
        .withColumn("field", F.lower(strip(F.substring_index("text", ":", 1))))
        .withColumn(
            "event",
            F.when(F.col("line") == "", "blank")
            .when(F.contains("text", F.lit(":")) & (F.col("field") == "user-agent"), "agent")
            .when(F.contains("text", F.lit(":")) & F.col("field").isin(_RULE_FIELDS), "rule"),
        )
        .where(F.col("event").isNotNull())
        .withColumn(
            "value", percent_decode(strip(F.regexp_replace("text", r"(?s)^[^:]*:", "")))
        )
    )
    starts = (F.col("event") == "blank") | (
        (F.col("event") == "agent") & (F.coalesce(F.lag("event").over(file), F.lit("")) != "agent")
    )
    numbered = events.withColumn("starts", starts).withColumn(
        "entry_no", F.sum(F.col("starts").cast("int")).over(upto)
    )
    entry = Window.partitionBy("origin", "entry_no").orderBy("line_no")
    whole = entry.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    members = numbered.withColumn("opens", F.first("event").over(whole) == "agent").where("opens")
    entries = members.groupBy("origin", "entry_no").agg(
        F.collect_list(F.when(F.col("event") == "agent", F.col("value"))).alias("agents"),
        F.count_if(F.col("event") == "rule").alias("n_rules"),
        F.array_sort(
            F.collect_list(
                F.when(
                    F.col("field").isin("allow", "disallow") & (F.col("event") == "rule"),
                    F.struct(
                        F.col("line_no").alias("rule_no"),
                        path_and_query(F.col("value"), keep_origin=True).alias("path"),
                        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
                    ),
                )
            )
        ).alias("rules"),
    )
    return entries.where("n_rules > 0").select(
        "origin", F.col("entry_no").cast("int").alias("entry_no"), "agents", F.explode_outer("rules").alias("r")
    ).select("origin", "entry_no", "agents", "r.rule_no", "r.path", "r.allow")


def _agent_rank(agent: str) -> Column:
    """0 for an entry that names a part of the agent's name, 1 for one for everyone, NULL for others."""
    name = agent.split("/")[0].lower()
    named = F.exists("agents", lambda a: F.contains(F.lit(name), F.lower(a)))
    return F.when(F.array_contains("agents", "*"), 1).when(named, 0)


def agent_rules(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """The one entry of each origin that applies to an agent: ``origin, rules``.

    The first entry naming a part of the agent's name applies, else the first entry for everyone.
    One row per origin, its rules in file order.
    """
    by_origin = Window.partitionBy("origin")
    return (
        rules.withColumn("rank", _agent_rank(agent))
        .where("rank IS NOT NULL")
        .withColumn("pick", F.struct("rank", "entry_no"))
        .withColumn("best", F.min("pick").over(by_origin))
        .where("pick = best")
        .groupBy("origin")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("path").isNotNull(), F.struct("rule_no", "path", "allow"))
                )
            ).alias("rules")
        )
    )


def robots_table(bodies: DataFrame, agent: str = AGENT) -> DataFrame:
    """``origin, policy, rules``: all that is needed to judge a URL, one row per origin."""
    return robots_policy(bodies).join(agent_rules(parse_robots(bodies), agent), "origin", "left")


def robots_allowed(url: Column, policy: Column, rules: Column) -> Column:
    """Verdict on one URL: the first rule whose path begins the URL's path decides."""
    path = path_and_query(percent_decode(url))
    first = F.try_element_at(
        F.filter(
            F.coalesce(rules, F.array().cast("array<struct<rule_no:int,path:string,allow:boolean>>")),
            lambda r: path.startswith(r["path"]),
        ),
        F.lit(1),
    )
    return (
        F.when(policy == "deny_all", F.lit(False))
        .when(policy == "rules", F.coalesce(first["allow"], F.lit(True)))
        .otherwise(F.lit(True))
    )


def robots_verdicts(urls: DataFrame, table: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed`` to rows with a URL.

    An equi-join on the origin whose right side has one row per origin, so a busy origin only
    makes its left side long, which adaptive execution splits.  The prefix test runs on the
    joined row, and nothing has to be regrouped by URL afterwards.
    """
    keyed = urls.withColumn("_origin", origin(F.col(url)))
    joined = keyed.join(table.withColumnRenamed("origin", "_origin"), "_origin", "left")
    return joined.withColumn(
        "allowed", robots_allowed(F.col(url), F.col("policy"), F.col("rules"))
    ).drop("_origin", "policy", "rules")


def agent_paths(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """Rules of the entry that applies to an agent, one row per path: ``origin, path, rule_no, allow``.

    Of two rules for one path the first decides.  Sums and joins only: an origin may have any number of rules.
    """
    ranked = rules.withColumn("rank", _agent_rank(agent)).where("rank IS NOT NULL")
    best = ranked.groupBy("origin").agg(F.min(F.struct("rank", "entry_no")).alias("pick"))
    chosen = ranked.join(best, "origin").where("struct(rank, entry_no) = pick AND path IS NOT NULL")
    return chosen.groupBy("origin", "path").agg(
        F.min("rule_no").alias("rule_no"), F.min_by("allow", "rule_no").alias("allow")
    )


def robots_verdicts_by_prefix(
    urls: DataFrame, policy: DataFrame, paths: DataFrame, url: str = "url"
) -> DataFrame:
    """The verdicts of :func:`robots_verdicts` by an equi-join on origin and path prefix.

    For origins with very many rules: ``paths`` has a row per rule (:func:`agent_paths`), and a URL meets
    only the rules that begin its path.  It is cut to the lengths that rule paths of its origin have, of which
    there are at most as many as the longest has characters.  Each different URL is judged once.
    """
    lengths = paths.groupBy("origin").agg(F.collect_set(F.length("path")).alias("_lengths"))
    asked = urls.select(F.col(url).alias("_url")).distinct().withColumns(
        {"origin": origin(F.col("_url")), "_path": path_and_query(percent_decode(F.col("_url")))}
    )
    judged = asked.join(policy, "origin", "left")
    cut = (
        judged.where("policy = 'rules'").join(lengths, "origin")
        .select("_url", "origin", "_path", F.explode("_lengths").alias("_length"))
        .where(F.col("_length") <= F.length("_path"))
        .select("_url", "origin", F.substr("_path", F.lit(1), F.col("_length")).alias("path"))
    )
    first = cut.join(paths, ["origin", "path"]).groupBy("_url").agg(F.min_by("allow", "rule_no").alias("allow"))
    verdict = (
        F.when(F.col("policy") == "deny_all", F.lit(False))
        .when(F.col("policy") == "rules", F.coalesce("allow", F.lit(True)))
        .otherwise(F.lit(True))
    )
    known = judged.join(first, "_url", "left").select("_url", verdict.alias("allowed"))
    return urls.join(known, urls[url] == known["_url"], "left").drop("_url").withColumn(
        "allowed", F.coalesce("allowed", F.lit(True))
    )
