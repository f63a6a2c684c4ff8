"""URL filters: rules indexed by their rarest literal token.

A rule can only fit an address that holds all of its whole tokens, so it is
filed under one of them: the one that the fewest addresses hold.  An address
looks up its own tokens, and only the rules found there run their regular
expressions.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, is_small, stored

#: Rules of a host with its subdomains, and the start of a path; the longest that fits decides.
HOST_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Patterns for addresses that no host rule fits.  ``^`` is a separator or an end, ``*`` any run of characters, ``||``
#: the start of a host label, ``|`` the start or end of the address; letters count in either case.
PATTERNS = (
    *(("block", f"^{word}^") for word in "casino poker bets betting lottery pills viagra spam adult porn xxx ads adserver track tracker payday".split()),
    ("block", "||click.*/redirect^"),
    ("allow", "^responsible^*^betting^"),
    ("allow", "^anti-spam^"),
    ("allow", "^spam-filter^"),
    ("allow", "||track.*/shipment^"),
)
#: Rules that are broadcast; a longer list meets the addresses in a shuffled join.
BROADCAST_RULES = 100_000
#: Addresses that one task takes for one token in the shuffled join.
SALT_ROWS = 1_000_000
_SMALL = dict(zip(map(ord, string.ascii_uppercase), string.ascii_lowercase))


def rule_table(spark: SparkSession, host_rules=HOST_RULES, patterns=PATTERNS, expressions=()) -> DataFrame:
    """Rules as rows (rule_id, kind, action, rule); ``expressions`` are regular expressions over small-letter addresses."""
    listed = [("host", *r) for r in host_rules] + [("pattern", *r) for r in patterns] + [("regex", *r) for r in expressions]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], "rule_id long, kind string, action string, rule string")


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}" for c in text)


def host_rule(rule: str) -> tuple[str, list[str]]:
    """Expression over ``host`` and ``path`` joined, and the tokens that every fitting address holds."""
    host, slash, path = rule.partition("/")
    host = host.translate(_SMALL)
    regex = r"^([^/]*\.)?" + _literal(host) + (_literal(slash + path) if slash else "(/|$)")
    # the path may go on behind its last character, so a token there is only the start of one
    ended = re.sub("[A-Za-z0-9]+$", "", path)
    return regex, re.findall("[a-z0-9]+", f"{host}/{ended.translate(_SMALL)}")


def pattern_rule(rule: str) -> tuple[str, list[str]]:
    """Expression over the small-letter address, and the tokens that every fitting address holds."""
    body = rule.translate(_SMALL)
    regex, left = "(?s)", False
    if body.startswith("||"):
        regex, body, left = regex + r"^([^/?#]*\.)?", body[2:], True
    elif body.startswith("|"):
        regex, body, left = regex + "^", body[1:], True
    last = body.endswith("|")
    body = body[:-1] if last else body
    tokens = []
    for m in re.finditer(r"[a-z0-9]+|[^a-z0-9]", body):
        part, after = m.group(), body[m.end() : m.end() + 1]
        if part == "*":
            regex, left = regex + ".*", False
        elif part == "^":
            at_start = m.start() == 0 and not left
            regex, left = regex + ("(^|[^a-z0-9])" if at_start else "([^a-z0-9]|$)"), True
        elif part.isascii() and part.isalnum():
            if left and (after != "*" if after else last):
                tokens.append(part)
            regex, left = regex + part, False
        else:
            regex, left = regex + _literal(part), True
    return regex + ("$" if last else ""), tokens


def compiled(rules: DataFrame) -> DataFrame:
    """Rules with their expression and distinct tokens; a raw expression has none, nor has a pattern without whole tokens."""

    def run(batches):
        for batch in batches:
            made = []
            for kind, rule in zip(batch.column("kind").to_pylist(), batch.column("rule").to_pylist()):
                made.append(host_rule(rule) if kind == "host" else pattern_rule(rule) if kind == "pattern" else (rule, []))
            columns = [pa.array([m[0] for m in made], pa.string()), pa.array([sorted(set(m[1])) for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "regex", "tokens"])

    given = rules.select(F.col("rule_id").cast("long").alias("rule_id"), "kind", "action", "rule").dropna()
    return given.mapInArrow(run, "rule_id long, kind string, action string, rule string, regex string, tokens array<string>")


def small(text: Column) -> Column:
    """A-Z in small letters, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def address_of(url: Column) -> Column:
    """What follows the first ``://``, the host in small letters; empty where there is none."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    after = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    return F.concat(small(host), F.substr(after, F.length(host) + 1))


def host_of(address: Column) -> Column:
    return F.regexp_extract(address, "^[^/?#]*", 0)


def path_of(address: Column) -> Column:
    return F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1)


def tokens_of(address: Column) -> Column:
    """Distinct tokens of an address, and the empty one, under which rules without a token are filed."""
    return F.array_distinct(F.array_append(F.split(small(address), "[^a-z0-9]+"), F.lit("")))


def rarest(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """The index: each rule under that of its tokens that the fewest addresses hold, with their number."""
    filed = rules.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    asked = broadcast_if_small(filed.select("token").distinct(), BROADCAST_RULES)
    counts = addresses.select(F.explode(tokens_of(F.col("address"))).alias("token")).join(asked, "token").groupBy("token").count()
    known = filed.join(counts, "token", "left").withColumn("held", F.coalesce("count", F.lit(0)))
    least = known.groupBy("rule_id").agg(F.min(F.struct("held", "token")).alias("least"))
    return rules.join(least, "rule_id").select("rule_id", "kind", "action", "rule", "regex", "least.token", "least.held")


def candidates(addresses: DataFrame, index: DataFrame) -> DataFrame:
    """Every pair of an address and a rule filed under one of its tokens.

    A short list of rules is broadcast.  A longer one is joined by a shuffle, in
    which a token of many addresses is dealt over several tasks, each with a
    copy of the rules filed under it.
    """
    listed = addresses.withColumn("token", F.explode(tokens_of(F.col("address"))))
    if is_small(index, BROADCAST_RULES):
        return listed.join(F.broadcast(index), "token")
    copies = F.ceil(F.col("held") / SALT_ROWS).cast("int")
    hot = index.where(F.col("held") > SALT_ROWS).select("token", copies.alias("copies")).distinct()
    salt = F.pmod(F.xxhash64("address"), F.coalesce("copies", F.lit(1)).cast("long"))
    dealt = listed.join(broadcast_if_small(hot), "token", "left").withColumn("salt", salt).drop("copies")
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(copies.cast("long"), F.lit(1)) - 1)))
    return dealt.join(spread, ["token", "salt"])


def best_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Per address that any rule fits: its host rule and its pattern, each as (action, rule).

    Of host rules the longest decides, of equal ones a block, then the first.
    Of patterns an exception (``allow``) decides, then the first.
    """
    made = stored(compiled(rules), "url-rules")
    index = stored(rarest(made, addresses), "url-index")
    address = F.col("address")
    subject = F.when(F.col("kind") == "host", F.concat(host_of(address), path_of(address))).otherwise(small(address))
    hits = candidates(addresses, index).where(F.regexp_like(subject, F.col("regex")))
    is_host = F.col("kind") == "host"
    host_order = F.struct(F.length("rule"), (F.col("action") == "block").alias("b"), -F.col("rule_id"), "action", "rule")
    order = F.struct((F.col("action") == "allow").alias("a"), -F.col("rule_id"), "action", "rule")
    return hits.groupBy("address").agg(F.max(F.when(is_host, host_order)).alias("host_rule"), F.max(F.when(~is_host, order)).alias("pattern"))


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """A verdict on every page's url: host, path, the host rule and the pattern that fit, and ``allow`` or ``block``.

    The host rule decides, where none fits the pattern, else the page is
    allowed.  Each distinct address is looked up once, so repeated urls cost
    one join row.  A null url, an empty one and one without ``://`` have an
    empty host and path, which no host rule fits; a url of any length is judged
    whole.  Repeated rows and null ids are kept.  An empty table gives no rows;
    without rules everything is allowed.  Rules with a null are left out.
    ``pages`` may have further columns of any name; only id and url are read.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), address_of(F.col("url")).alias("address"))
    addresses = stored(plain.select("address").distinct(), "addresses")
    best = best_rules(addresses, rules)
    return plain.join(best, "address", "left").select(
        "page_id",
        host_of(F.col("address")).alias("host"),
        path_of(F.col("address")).alias("path"),
        F.col("host_rule.rule").alias("rule"),
        F.coalesce("host_rule.action", "pattern.action", F.lit("allow")).alias("verdict"),
        F.col("pattern.rule").alias("pattern"),
    )
