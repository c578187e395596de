"""robots.txt: lines to rules, the group of an agent, and the longest matching rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archloom.functions.url import lower, path, query, trim

AGENT = "archloom"


def directives(files: DataFrame) -> DataFrame:
    """Rows host, pos, field, value, block: a run of agent lines and what follows it is a block."""
    d = files.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "line"))
    d = d.withColumn("line", trim(F.regexp_replace("line", "#.*$", ""))).where(F.col("line").contains(":"))
    d = d.select("host", "pos", lower(trim(F.regexp_extract("line", "^([^:]*):", 1))).alias("field"), trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("value"))
    d = d.where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    w = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    return d.withColumn("block", F.sum(opens.cast("int")).over(w))


def rules(files: DataFrame) -> DataFrame:
    """Rows host, agent, pos, allow, pattern, len; an empty disallow says nothing."""
    d = directives(files)
    agents = d.where("field = 'user-agent'").select("host", "block", lower(F.col("value")).alias("agent")).distinct()
    said = d.where("field in ('allow', 'disallow')").where("not (field = 'disallow' and value = '')")
    said = said.select("host", "block", "pos", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), F.octet_length("value").alias("len"))
    return agents.join(said, ["host", "block"]).select("host", "agent", "pos", "allow", "pattern", "len")


def group(rule_rows: DataFrame, agent: str = AGENT) -> DataFrame:
    """Rows host, agent: the first group with rules whose name is the agent's or part of it, or else *."""
    fits = F.when((F.col("agent") != "*") & F.lit(agent).contains(F.col("agent")), 0).when(F.col("agent") == "*", 1)
    d = rule_rows.withColumn("fits", fits).where("fits is not null")
    return d.groupBy("host").agg(F.min_by("agent", F.struct("fits", "pos")).alias("agent"))


def delays(files: DataFrame, agent: str = AGENT) -> DataFrame:
    """Rows host, delay: the seconds that the agent's group asks for, or else those of `*`; null where neither does."""
    d = directives(files)
    agents = d.where("field = 'user-agent'").select("host", "block", lower(F.col("value")).alias("agent")).distinct()
    said = d.where("field = 'crawl-delay'").select("host", "block", "pos", F.col("value").try_cast("double").alias("delay"))
    asked = agents.join(said, ["host", "block"]).groupBy("host", "agent").agg(F.min_by("delay", "pos").alias("delay"))
    own = group(rules(files), agent).join(asked, ["host", "agent"]).select("host", F.col("delay").alias("own"))
    anyone = asked.where("agent = '*'").select("host", F.col("delay").alias("anyone"))
    return files.select("host").distinct().join(own, "host", "left").join(anyone, "host", "left").select("host", F.coalesce("own", "anyone").alias("delay"))


def pattern_regex(pattern: Column) -> Column:
    """Java pattern of a rule: * is anything, a last $ is the end."""
    ends = pattern.endswith("$")
    body = F.regexp_replace(F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern), r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(ends, "$").otherwise(""))


def allowed(urls: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows url, allowed from urls (url, host) and rules (host, allow, pattern, len) of the chosen groups.

    The longest pattern that matches decides, Allow among equals; no match is allowed. A pattern can
    match only a target that begins with its head, the part before a wildcard. So a URL is taken apart
    into its beginnings, of the lengths that heads of its host have, and each beginning meets the rules
    of that head: as many look-ups as there are lengths, however many rules. What is no more than a
    head matches then and there; the rest of the others is matched as an expression.
    """
    target = F.concat(path(F.col("url")), F.when(query(F.col("url")) == "", "").otherwise(F.concat(F.lit("?"), query(F.col("url")))))
    body = F.regexp_replace("pattern", r"\$$", "")
    rules = chosen.groupBy("host", "pattern").agg(F.max("len").alias("len"), F.max("allow").alias("allow"))
    rules = rules.withColumns({"head": F.substring_index(body, "*", 1), "plain": ~F.col("pattern").contains("*") & ~F.col("pattern").endswith("$")})
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("lengths"))  # no more than the longest target has characters
    d = urls.select("url", "host").distinct().withColumn("target", F.explode(F.array(target)))
    parts = d.join(lengths, "host").select("url", "host", "target", F.explode("lengths").alias("n")).where(F.length("target") >= F.col("n"))
    met = parts.withColumn("head", F.substring("target", F.lit(1), F.col("n"))).join(rules.withColumn("re", F.when(~F.col("plain"), pattern_regex(F.col("pattern")))), ["host", "head"])
    hit = met.where(F.col("plain") | F.expr("target rlike re"))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct("len", "allow")).alias("allowed"))
    return d.select("url").distinct().join(best, "url", "left").select("url", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def crawl_delay(robots: Column, option: Column) -> Column:
    """Seconds between batches: the larger of the option and the robots delay, which is held to 0 to 30."""
    return F.greatest(option, F.greatest(F.lit(0.0), F.least(F.lit(30.0), F.coalesce(robots, F.lit(0.0)))))
