"""URL rules found by their rarest literal token.

A rule is a regular expression over host and path. The words that any matching URL must hold (its
literal tokens: runs of ``a-z0-9`` that are whole in every match) are listed with it. Each rule is
filed under the one of its tokens that the fewest URLs hold, counted over all URLs. A URL's tokens
fetch the rules filed under them, and only those run their regular expression. Rules without any
literal token are tried on every URL.

Work is done on distinct URLs, and only with DataFrame functions. The index is sent to all tasks
while it has at most ``BROADCAST_RULES`` rules; a longer one is joined by a shuffle in which the
URLs' tokens are salted and the index is repeated for the salts, so that a token held by a third
of the URLs is spread.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up
to ``?``, ``#`` or the end. A null URL, and one without ``://``, has both empty and fits only
rules that match emptiness; the default verdict holds for it. Of the fitting rules the one with
the highest priority wins, then the first by name. Repeated rows are judged each; tables without
rows give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casedesk.llm.frames import fresh, named

BROADCAST_RULES = 100_000
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are whole words of every match."""

    name: str
    pattern: str
    verdict: str
    priority: int
    tokens: tuple[str, ...]
    shown: bool = True


def words_of(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.translate(
        str.maketrans(UPPER, LOWER)))))


def site_rule(site: str, verdict: str) -> Rule:
    """Rule for a host with all its subdomains and a path start, like ``example.net/en/``.

    Longer sites win over shorter ones and over pattern rules. A last path part that may go on
    (no slash behind it) is no literal token.
    """
    host, slash, path = site.partition("/")
    path = slash + path
    whole = path if path.endswith("/") else path[: path.rfind("/") + 1]
    pattern = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    return Rule(site, pattern, verdict, 1000 + len(site), words_of(host + whole))


def word_rule(name: str, words: str, verdict: str, priority: int = 0) -> Rule:
    """Rule for neighbouring whole words anywhere in host or path, like ``cheap-pills``."""
    pattern = r"(?<![a-z0-9])" + re.escape(words) + r"(?![a-z0-9])"
    return Rule(name, "(?i)" + pattern, verdict, priority, words_of(words), shown=False)


SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"),
              site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))

# Names of sites and pages that carry no prose worth keeping, where no site rule decides.
SPAM_WORDS = ("adult", "xxx", "porn", "escort", "casino", "poker", "betting", "free-bets",
              "cheap-pills", "viagra", "payday-loan", "spam-farm", "link-farm", "ads-track",
              "adserver", "torrent", "warez", "replica-watches")
RULES = SITE_RULES + tuple(word_rule(w, w, "block") for w in SPAM_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def url_tokens(site: Column) -> Column:
    low = F.translate(site, UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9]+)"), 1))


INDEX_DDL = "token string, rule_id int, rule string, pattern string, verdict string, priority int"


def rarest_tokens(sites: DataFrame, rules: list[Rule]) -> list[str | None]:
    """For each rule the one of its tokens that the fewest URLs hold; None if it has none.

    ``sites`` holds the tokens of all URLs. What comes back is one count per rule token.
    """
    spark = sites.sparkSession
    own = sorted({t for r in rules for t in r.tokens})
    known = spark.createDataFrame([(t,) for t in own], "token string")
    counts = dict(sites.select(F.explode("tokens").alias("token"))
                  .join(_sent(known, len(own)), "token").groupBy("token").count().collect())
    return [min(((counts.get(t, 0), t) for t in r.tokens), default=(0, None))[1] for r in rules]


def _sent(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_RULES else df


def candidates(sites: DataFrame, rules: list[Rule]) -> DataFrame:
    """Pairs of site and rule whose rarest token the site holds, or that has none."""
    filed = list(zip(rarest_tokens(sites, rules), range(len(rules)), rules, strict=True))

    def row(token, i, r):
        return token, i, r.name if r.shown else None, r.pattern, r.verdict, r.priority

    index = sites.sparkSession.createDataFrame(
        [row(*f) for f in filed if f[0] is not None], INDEX_DDL)
    held = sites.select("site", F.explode("tokens").alias("token"))
    if len(rules) <= BROADCAST_RULES:
        found = held.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = held.withColumn("salt", F.pmod(F.xxhash64("site"), F.lit(SALTS)).cast("int")) \
            .join(salted, ["token", "salt"]).drop("salt")
    found = found.drop("token")
    free = [row(*f)[1:] for f in filed if f[0] is None]
    if not free:
        return found
    # Rules without a literal word are tried on every site, in its own row.
    names = found.columns[1:]
    listed = F.array(*[F.struct(*[F.lit(v).cast(found.schema[n].dataType).alias(n)
                                  for n, v in zip(names, f, strict=True)]) for f in free])
    return found.unionByName(sites.select("site", F.inline(listed)))


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow",
           url_col: str = "url") -> DataFrame:
    """All rows and columns with host, path, rule and verdict.

    A column of one of these four names is replaced. ``rule`` is null where no shown rule
    decides: pattern rules give a verdict without a name.
    """
    row, key = fresh(pages, "row", "site")
    host, path = host_and_path(named(url_col).cast("string"))
    # The host ends where the path's slash begins, so the two can be told apart in one string.
    left = pages.select(F.struct(*[named(c) for c in pages.columns]).alias(row),
                        host.alias("host"), path.alias("path"),
                        F.concat(host, path).alias(key))
    sites = (left.select(F.col(key).alias("site")).distinct()
             .withColumn("tokens", url_tokens(F.col("site"))))
    fits = candidates(sites, sorted(rules, key=lambda r: r.name)).where("regexp_like(site, pattern)")
    best = (fits.groupBy("site")
            .agg(F.min_by(F.struct("rule", "verdict"),
                          F.struct(-F.col("priority"), F.col("rule_id"))).alias("best")))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("best.rule"),
           "verdict": F.coalesce("best.verdict", F.lit(default))}
    return (left.join(best, left[key] == best["site"], "left")
            .select(*[F.col(row)[c].alias(c) for c in pages.columns if c not in new],
                    *[value.alias(name) for name, value in new.items()]))
