"""URL filter: pattern rules indexed by their rarest literal token. DataFrame functions only.

Each rule is a regular expression; the literal tokens (runs of a-z0-9) that every matching url must contain are read off
the parsed expression. The url table's own token counts choose each rule's rarest token as its index key. A url's tokens
fetch the rules filed under them by an equi-join, and only those run their expression on that url. A rule without a
literal token is filed under the empty token, which every url carries. The longest matching rule (`rank`, ties to the
smaller id) wins.

Defined cases: a null url, or one without "://", has an empty host and path and is matched by no rule; repeated urls
are judged once and joined back to every row; an empty table gives an empty result. Other columns pass through, whatever
their names; those named host, path, rule, verdict or pattern give way to the added ones.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import free_name, plain_columns, spread_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A rule index of more entries than this is joined by shuffle instead of broadcast.
BROADCAST_RULES = 100_000

#: Fixed values: (host, path, verdict) rules of the production filter.
HOST_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Fixed values: (name, expression on host + path + query) of the generic filter, which blocks.
PATTERN_RULES = [
    ("ad-path", r"/ad/"),
    ("ads-path", r"/ads/"),
    ("adserver", r"^([^/?#]*\.)?adserver\."),
    ("doubleclick", r"^([^/?#]*\.)?doubleclick\.net/"),
    ("googlesyndication", r"^([^/?#]*\.)?googlesyndication\.com/"),
    ("wp-login", r"/wp-login\.php"),
    ("wp-admin", r"/wp-admin/"),
    ("xmlrpc", r"/xmlrpc\.php"),
    ("cgi-bin", r"/cgi-bin/"),
    ("casino", r"(^|[^A-Za-z0-9])casino([^A-Za-z0-9]|$)"),
    ("poker", r"(^|[^A-Za-z0-9])poker([^A-Za-z0-9]|$)"),
    ("porn", r"(^|[^A-Za-z0-9])porn([^A-Za-z0-9]|$)"),
    ("xxx", r"(^|[^A-Za-z0-9])xxx([^A-Za-z0-9]|$)"),
    ("viagra", r"(^|[^A-Za-z0-9])viagra([^A-Za-z0-9]|$)"),
    ("phpsessid", r"[?&]phpsessid="),
    ("jsessionid", r"[;?&]jsessionid="),
    ("checkout", r"/cart/checkout"),
    ("trackback", r"/trackback/"),
]
RULE_SCHEMA = "rule_id long, rule string, regex string, tokens array<string>, rank int, verdict string"


def literal_tokens(expression: str) -> list[str]:
    """The whole tokens (runs of a-z0-9, other characters or an end on either side) of every string that matches.

    The expression is cut into places: a literal character, an edge (an anchor, or what can't be a letter or digit), or
    anything else. A run of literals counts between two edges.
    """
    alnum = set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123))

    def edge(item) -> bool:
        kind, value = item
        if kind in (sre.LITERAL, sre.NOT_LITERAL):
            return kind == sre.LITERAL and value < 128 and value not in alnum
        if kind == sre.AT:
            return value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING, sre.AT_END, sre.AT_END_STRING)
        if kind == sre.IN:
            inside = {c for k, v in value for c in ([v] if k == sre.LITERAL else range(v[0], v[1] + 1) if k == sre.RANGE else [])}
            plain = all(k in (sre.LITERAL, sre.RANGE, sre.NEGATE) for k, _ in value)
            return plain and (alnum <= inside if value[0][0] == sre.NEGATE else not alnum & inside)
        if kind == sre.SUBPATTERN:
            return len(value[3]) > 0 and edge(value[3][0]) and edge(value[3][-1])
        return kind == sre.BRANCH and all(len(x) == 1 and edge(x[0]) for x in value[1])

    def places(items, before: bool) -> list:
        out: list = []
        for item in items:
            kind, value = item
            if kind == sre.LITERAL and value in alnum:
                out.append(chr(value))
            elif kind == sre.MAX_REPEAT and value[0] == 0 and (out[-1] is True if out else before) and len(value[2]) and _ends(value[2]):
                out.append(True)  # left out, an edge is before; else one ends it
            else:
                out.append(edge(item))
        return out

    def _ends(items) -> bool:
        kind, value = items[-1]
        return _ends(value[3]) if kind == sre.SUBPATTERN and len(value[3]) else edge(items[-1])

    found, run, open_ = [], "", False
    for place in [*places(parser.parse(expression), False), False]:
        if isinstance(place, str):
            run += place
            continue
        if run and open_ and place and re.fullmatch("[a-z0-9]+", run):
            found.append(run)
        run, open_ = "", place
    return found


def host_path_rule(rule_id: int, host: str, path: str, verdict: str) -> tuple:
    """A rule for a host with all its subdomains and a path prefix."""
    regex = rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
    return rule_id, host + path, regex, literal_tokens(regex), len(host + path), verdict


def production_rules() -> list[tuple]:
    rules = [host_path_rule(i, *r) for i, r in enumerate(HOST_RULES)]
    return rules + [(100 + i, name, regex, literal_tokens(regex), 0, "block") for i, (name, regex) in enumerate(PATTERN_RULES)]


def split_url(url):
    """host (A-Z lower-cased) and path columns, both empty without "://"."""
    there = F.instr(url, "://") > 0
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.when(there, host).otherwise(empty), F.when(there, path).otherwise(empty), F.when(there, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)).otherwise(empty)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule (the winner's name) and verdict; rules as RULE_SCHEMA."""
    pages = pages.drop("host", "path", "rule", "verdict", "pattern")
    key, best_ = free_name(pages, "url"), free_name(pages, "best")
    host, path, tail = split_url(F.col(url))
    seen = pages.select(F.col(url).alias(key)).where(F.col(key).isNotNull()).distinct()
    host_u, path_u, tail_u = split_url(F.col(key))
    target = F.concat(host_u, tail_u)
    lowered = F.translate(target, UPPER, LOWER)
    tokens = F.array_union(F.array(F.lit("")), F.array_distinct(F.filter(F.split(lowered, "[^a-z0-9]+"), lambda t: t != "")))
    exploded = seen.where(host_u != "").select(key, F.explode(tokens).alias("token"))

    wanted = rules.select("rule_id", F.explode_outer("tokens").alias("token")).select("rule_id", F.coalesce("token", F.lit("")).alias("token")).distinct()
    small = rules.count() <= BROADCAST_RULES
    near = F.broadcast if small else (lambda x: x)
    counts = exploded.join(near(wanted.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    filed = (
        wanted.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("least"))
        .select("rule_id", F.col("least.token").alias("token"))
        .join(rules.select("rule_id", "rule", "regex", "rank", "verdict"), "rule_id")
    )
    fetched = exploded.join(near(filed), "token").where(F.expr(f"rlike(concat({_sql(key)}), regex)"))
    best = fetched.groupBy(key).agg(F.max(F.struct("rank", (-F.col("rule_id")).alias("first"), "rule", "verdict")).alias(best_))
    # Urls without a rule, null ones and a frequent one's rows are dealt over tasks.
    joined = spread_join(pages.withColumn(key, F.col(url)), best, [key], plain_columns(pages), "left")
    best_of = lambda field: F.col(f"{best_}.{field}")
    generic = best_of("rank") == 0
    return joined.select(
        *[F.col(f"`{c}`") for c in pages.columns], host.alias("host"), path.alias("path"),
        F.when(~generic, best_of("rule")).alias("rule"), F.coalesce(best_of("verdict"), F.lit(default)).alias("verdict"),
        F.when(generic, best_of("rule")).alias("pattern"),
    )


def _sql(key: str) -> str:
    """The string that expressions run on: lower-cased host, then the url's tail."""
    rest = f"regexp_extract(`{key}`, '(?s)^.*?://(.*)$', 1)"
    return f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), regexp_extract({rest}, '(?s)^[^/?#]*(.*)$', 1)"


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(production_rules(), RULE_SCHEMA)
    return filter_urls(pages, rules).drop("url")


def oracle() -> str:
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    generic = "CASE " + " ".join(f"WHEN regexp_matches(target, '{regex}') THEN '{name}'" for name, regex in PATTERN_RULES) + " END"
    ranked = sorted(HOST_RULES, key=lambda r: -len(r[0] + r[1]))
    fits = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '%s'" for h, p, _ in ranked) + " END"
    rule = fits % tuple(h + p for h, p, _ in ranked)
    verdict = fits % tuple(v for _, _, v in ranked)
    return f"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, {lower % "regexp_extract(rest, '^([^/?#]*)', 1)"} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    {lower % "regexp_extract(rest, '^([^/?#]*)', 1)"} || regexp_extract(rest, '(?s)^[^/?#]*(.*)$', 1) AS target FROM parts
), judged AS (SELECT *, {rule} AS rule, {verdict} AS host_verdict, CASE WHEN host <> '' THEN {generic} END AS generic FROM cut)
SELECT page_id, host, path, rule, coalesce(host_verdict, CASE WHEN generic IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN generic END AS pattern FROM judged"""
