"""URL filter by path-template trees, with DataFrame functions only.

Host rules decide first; the longest that fits wins. What they decide is also the labelled part of
the pages. For every host the paths form a tree of segments. Level by level, a node's children
become one wildcard if they are variable (many, nearly one for each page), and those children whose
share of blocked pages doesn't differ significantly from their siblings' are merged into the same
wildcard; only distinctive branches keep their name. A path's template is its way down the tree.

A template is rejected by its smoothed purity: the share of blocked among its labelled pages,
drawn towards the share of the same template over all hosts, which is drawn towards the share of
all labelled pages. Pages that no rule decides get the verdict of their template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import PARTS, discard, each_part, materialize, part_of, parts_held, reread

#: (rule, verdict); a rule is a host and a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MANY, NEARLY, Z, STRENGTH = 8, 0.5, 3.0, 4.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last to fit is the longest
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(
    pages: DataFrame, page: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES,
    many: int = MANY, nearly: float = NEARLY, z: float = Z, strength: float = STRENGTH,
) -> DataFrame:
    """(page, host, path, rule, template, purity, verdict) for each row of ``pages``.

    Children are variable if a node has ``many`` or more, and ``nearly`` or more for each
    page. A null url or one without ``://`` has empty host and path, which no rule fits. Without labelled pages every
    purity is a half, and such pages are allowed. Repeated rows are judged each. Other columns are not read. No rows give no rows.

    Paths are followed to their last segment. No child of a node differs significantly unless its labelled pages have both
    verdicts, ``z`` squared or more of them one; below other nodes all is wildcards, so such paths leave at once. There is a round
    for each level at which a node is left, over the paths below such nodes only.

    What is known of a host, node or path that many rows share is joined to them in parts.
    """
    host, path = F.col("host"), F.col("path")
    base = pages.select(F.col(page).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, says = rule_of(host, path, rules)
    base = materialize(base.withColumns({"rule": rule, "says": says, "part": part_of("page")}))
    # equal paths of a host go down the tree together
    nodes = base.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(F.col("says") == "allow").alias("good"), F.count_if(F.col("says") == "block").alias("bad"), parts_held(F.col("part")).alias("pages_in")
    )
    size, every_part = F.size("segments"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")
    start = materialize(nodes.withColumns({"segments": F.split(F.regexp_replace(path, "^/", ""), "/"), "template": F.lit(""), "part": part_of("path")}))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    share = F.try_divide(F.col("all_bad"), F.col("all_good") + F.col("all_bad"))
    own = F.col("good") + F.col("bad")
    apart = F.abs(F.try_divide(F.col("bad"), own) - share) > z * F.sqrt(F.try_divide(share * (1 - share), own))
    here, level, rounds = start, 0, []
    while not rounds or not here.isEmpty():
        here = here.withColumn("segment", F.get("segments", F.lit(level)))
        children = here.groupBy("host", "template", "segment").agg(*sums).withColumn("part", part_of("segment"))
        parents = children.groupBy("host", "template").agg(F.count("*").alias("k"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "good", "bad")), parts_held(F.col("part")).alias("held"))
        mixed = parents.where((F.least("all_good", "all_bad") > 0) & (F.greatest("all_good", "all_bad") >= z * z))
        kept = (
            children.join(mixed.withColumn("part", each_part(F.col("held"))), ["host", "template", "part"])
            .where(((F.col("k") < many) | (F.col("k") < nearly * F.col("all_n"))) & (own > 0) & apart)
            .select("host", "template", "segment", F.lit(True).alias("named"), every_part)
        )
        here = here.join(mixed.select("host", "template", F.lit(True).alias("mixed"), every_part), ["host", "template", "part"], "left")
        here = here.join(kept, ["host", "template", "segment", "part"], "left")
        step = F.when(F.col("mixed"), F.concat(F.lit("/"), F.when(F.col("named"), F.col("segment")).otherwise("*"))).otherwise(F.repeat(F.lit("/*"), size - level))
        level += 1
        rounds.append(materialize(here.withColumns({"template": F.concat("template", step), "open": F.col("mixed").isNotNull() & (size > level)}).drop("segment", "mixed", "named")))
        here = rounds[-1].where("open").drop("open")
    discard(start)
    nodes = reread(rounds).where("NOT open")
    half = F.lit(0.5)
    by_host = nodes.groupBy("host", "template").agg(*sums, parts_held(F.col("part")).alias("held"))
    by_template = by_host.groupBy("template").agg(F.sum("good").alias("t_good"), F.sum("bad").alias("t_bad"))
    total = by_host.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good") + F.sum("bad"), F.lit(0))).first()
    prior = (F.lit(total[0]) + strength * half) / (F.lit(total[1]) + strength)
    above = (F.col("t_bad") + strength * prior) / (F.col("t_good") + F.col("t_bad") + strength)
    purity = (F.col("bad") + strength * above) / (F.col("good") + F.col("bad") + strength)
    verdicts = by_host.join(by_template, "template").select("host", "template", purity.alias("purity"), each_part(F.col("held")).alias("part"))
    judged = nodes.join(verdicts, ["host", "template", "part"]).select("host", "path", "template", "purity", each_part(F.col("pages_in")).alias("part"))
    return base.join(judged, ["host", "path", "part"]).select(
        F.col("page").alias(page), "host", "path", "rule", "template", "purity", F.coalesce("says", F.when(F.col("purity") > 0.5, "block").otherwise("allow")).alias("verdict")
    )


def oracle(many: int = MANY, nearly: float = NEARLY, z: float = Z, strength: float = STRENGTH) -> str:
    """The query over table ``pages`` and RULES for DuckDB."""
    rule = says = "NULL"
    for text, verdict in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = text.partition("/")
        fits = f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash + rest}')"
        rule, says = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {says} END"
    return f"""
WITH RECURSIVE parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
base AS (SELECT *, {rule} AS rule, {says} AS says FROM parsed),
paths AS (SELECT host, path, string_split(regexp_replace(path, '^/', ''), '/') AS parts, count(*) AS n,
  count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM base GROUP BY host, path),
walk AS (
  SELECT 0 AS level, host, path, parts, n, good, bad, '' AS template FROM paths
  UNION ALL
  SELECT level + 1, host, path, parts, n, good, bad, template || CASE WHEN (k < {many} OR k < {nearly} * all_n) AND c_good + c_bad > 0
    AND abs(c_bad / (c_good + c_bad) - share) > {z} * sqrt(share * (1 - share) / (c_good + c_bad)) THEN '/' || segment ELSE '/*' END
  FROM (
    SELECT *, sum(first) OVER node AS k, sum(n) OVER node AS all_n, sum(bad) OVER node / (sum(good) OVER node + sum(bad) OVER node) AS share
    FROM (
      SELECT *, sum(good) OVER child AS c_good, sum(bad) OVER child AS c_bad, (row_number() OVER child = 1)::INT AS first
      FROM (SELECT *, parts[level + 1] AS segment FROM walk WHERE level < len(parts))
      WINDOW child AS (PARTITION BY host, template, segment))
    WINDOW node AS (PARTITION BY host, template))),
nodes AS (SELECT * FROM walk WHERE level = len(parts)),
by_host AS (SELECT host, template, sum(good) good, sum(bad) bad FROM nodes GROUP BY ALL),
by_template AS (SELECT template, sum(good) t_good, sum(bad) t_bad FROM by_host GROUP BY ALL),
total AS (SELECT (coalesce(sum(bad), 0) + {strength} * 0.5) / (coalesce(sum(good) + sum(bad), 0) + {strength}) AS prior FROM by_host),
verdicts AS (SELECT host, template, (bad + {strength} * ((t_bad + {strength} * prior) / (t_good + t_bad + {strength}))) / (good + bad + {strength}) AS purity
  FROM by_host JOIN by_template USING (template), total)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM base JOIN (SELECT host, path, purity FROM nodes JOIN verdicts USING (host, template)) USING (host, path)
"""
