"""Secrets in texts: fixed forms, and strings that a battery of randomness tests finds too random to be words.

Everything here is SQL expressions over whole texts.  Spans are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import whole_text

#: The forms that are always looked for, in the order in which spans of one start are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the run after AKIA, 18 characters in all
HEX = r"[0-9a-f]{16,}"  # whole runs of at least 16
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 12

#: Strings that are tested for randomness.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabet of each encoding, in the order of its digits, and how often neighbours of a random string differ in class
#: (capitals, small letters, digits, signs).
ENCODINGS = {
    "hex": ("0123456789abcdef", "0123456789ABCDEF", 0.469),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.305),
    "base64": (
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
        0.644,
    ),
}
#: Ordinary strings: how often two of their characters are equal, and neighbours differ in class.
ORDINARY_EQUAL, ORDINARY_CHANGE = 0.065, 0.15
#: A string is random in form if no test of the battery is this many deviations off.
BATTERY = 3.5
#: Share of ordinary strings tolerated among those reported.
FALSE_DISCOVERIES = 0.01
#: Steps of the scale of p-values per power of ten, and its end.
STEPS, LAST_STEP = 20, 1200


def _matches(text: str, pattern: str, group: int | None = None) -> str:
    """SQL for the leftmost matches as ``array<struct<start, stop, size, match>>``; ``size`` is the length of the group."""
    literal = "r'" + pattern.replace("'", "\\x27") + "'"
    size = f"regexp_extract_all({text}, {literal}, {group})" if group else f"regexp_extract_all({text}, {literal}, 0)"
    empty = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, stop: BIGINT, size: INT, match: STRING>>)"
    return f"""
      CASE WHEN {text} RLIKE {literal} THEN
        aggregate(
          arrays_zip(slice(split({text}, {literal}, -1), 1, size(regexp_extract_all({text}, {literal}, 0))),
                     regexp_extract_all({text}, {literal}, 0), {size}),
          struct(CAST(0 AS BIGINT) AS at, {empty} AS found),
          (s, x) -> struct(
            s.at + char_length(x.`0`) + char_length(x.`1`) AS at,
            concat(s.found, array(struct(
              s.at + char_length(x.`0`) AS start, s.at + char_length(x.`0`) + char_length(x.`1`) AS stop,
              char_length(x.`2`) AS size, x.`1` AS match))) AS found),
          s -> s.found)
      ELSE {empty} END"""


def base_spans(text: str) -> str:
    """SQL for the spans of the fixed forms, sorted, as ``array<struct<start, kind, stop>>``; kinds by number."""
    parts = [
        f"transform(filter({_matches(text, ASSIGN, 2)}, m -> m.size >= {ASSIGN_LEAST}), m -> struct(m.start AS start, 0 AS kind, m.stop AS stop))",
        f"transform({_matches(text, ACCESS)}, m -> struct(m.start AS start, 1 AS kind, m.stop AS stop))",
        f"transform({_matches(text, HEX)}, m -> struct(m.start AS start, 2 AS kind, m.stop AS stop))",
    ]
    return f"array_sort(concat({', '.join(parts)}))"


def _tail(z: str) -> str:
    """SQL for the decimal logarithm of a normal deviate's upper tail, negated; a close upper bound of the tail beyond 0."""
    return f"CASE WHEN {z} <= 0.5 THEN 0.3 ELSE ({z} * {z} / 2 + ln({z} * 2.506628)) / ln(10) END"


def battery(token: str) -> str:
    """SQL for what the tests say about a string, as a step on the scale of its p-value as an ordinary string.

    The alphabet is inferred from the characters.  Null if a test excludes
    that the string is random over it: chi-squared for equal use of the
    alphabet, runs of neighbours in one class, serial correlation of
    neighbouring digits.  Otherwise equal characters (the chi-squared sum) and
    runs are compared with ordinary strings and both deviates are combined.
    """
    kind = f"""CASE WHEN {token} RLIKE '^[0-9]+$' THEN NULL
        WHEN {token} RLIKE '^([0-9a-f]+|[0-9A-F]+)$' THEN 'hex'
        WHEN {token} RLIKE '^[A-Z2-7]+=*$' THEN 'base32' ELSE 'base64' END"""
    one = "CASE e {} END"
    alphabet = one.format(" ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, _, _) in ENCODINGS.items()))
    other = one.format(" ".join(f"WHEN '{k}' THEN '{b}'" for k, (_, b, _) in ENCODINGS.items()))
    change = one.format(" ".join(f"WHEN '{k}' THEN {c}D" for k, (_, _, c) in ENCODINGS.items()))
    ranks = f"""filter(transform(regexp_extract_all({token}, '.', 0),
        c -> CAST(greatest(locate(c, {alphabet}), locate(c, {other})) AS INT)), v -> v > 0)"""

    def step(names: str, values: list[str], body: str) -> str:
        """Name intermediate values: one struct in an array, mapped once."""
        return f"transform(array(struct({', '.join(f'{v} AS {n}' for n, v in zip(names.split(), values))})), {body})[0]"

    classes = "translate(regexp_replace(regexp_replace(regexp_replace({t}, '[A-Z]', 'A'), '[a-z]', 'a'), '[0-9]', '0'), '+/_-', '....')".format(
        t=f"rtrim('=', {token})"
    )
    result = f"""CASE WHEN k.n < 16 OR abs(k.zr) > {BATTERY} OR k.zc > {BATTERY} OR abs(k.zs) > {BATTERY} THEN NULL
      ELSE CAST(least({LAST_STEP}, floor({STEPS} * (({_tail('k.z')}) + log10(least(4D, greatest(0.25D, k.n / 32D)))))) AS INT) END"""
    deviates = step(
        "n zc zr zs z",
        [
            "s.n",
            "(s.chi - (s.k - 1)) / sqrt(2 * (s.k - 1) * (s.n - 1) / s.n)",
            "(s.changes - (s.n - 1) * s.tau) / sqrt((s.n - 1) * s.tau * (1 - s.tau))",
            "CASE WHEN s.var > 0 THEN (s.cov / s.var + 1D / (s.n - 1)) * sqrt(s.n) ELSE 99D END",
            f"""((s.k + s.k * (s.n - 1) * {ORDINARY_EQUAL}D - s.n - s.chi)
                  / sqrt(2 * s.k * s.k * (s.n - 1) / s.n * {ORDINARY_EQUAL * (1 - ORDINARY_EQUAL)}D)
               + (s.changes - (s.n - 1) * {ORDINARY_CHANGE}D) / sqrt((s.n - 1) * {ORDINARY_CHANGE * (1 - ORDINARY_CHANGE)}D)) / sqrt(2D)""",
        ],
        f"k -> {result}",
    )
    sums = step(
        "n k tau chi changes cov var",
        [
            "r.n",
            "r.k",
            "r.tau",
            "r.k / r.n * aggregate(array_distinct(r.v), 0D, (a, x) -> a + pow(size(filter(r.v, y -> y = x)), 2)) - r.n",
            "size(filter(zip_with(slice(r.c, 1, r.m - 1), slice(r.c, 2, r.m - 1), (a, b) -> a <> b), d -> d))",
            "aggregate(zip_with(slice(r.v, 1, r.m - 1), slice(r.v, 2, r.m - 1), (a, b) -> (a - r.mean) * (b - r.mean)), 0D, (a, x) -> a + x)",
            "aggregate(r.v, 0D, (a, x) -> a + pow(x - r.mean, 2))",
        ],
        f"s -> {deviates}",
    )
    readings = step(
        "v c n m k tau mean",
        [
            "q.v",
            f"regexp_extract_all({classes}, '.', 0)",
            "CAST(size(q.v) AS DOUBLE)",
            "size(q.v)",
            "q.k",
            "q.tau",
            "aggregate(q.v, 0D, (a, x) -> a + x) / size(q.v)",
        ],
        f"r -> CASE WHEN r.n >= 2 AND size(r.c) = r.m THEN {sums} END",
    )
    alphabets = f"transform(array({kind}), e -> CASE WHEN e IS NOT NULL THEN struct({ranks} AS v, CAST(length({alphabet}) AS DOUBLE) AS k, {change} AS tau) END)"
    return f"transform({alphabets}, q -> CASE WHEN q IS NOT NULL THEN {readings} END)[0]"


def _looked_at(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``base`` spans and ``maybe``, strings that passed the battery with their step, beside the kept columns."""
    seen = docs.select(*keep, F.expr(base_spans("__text")).alias("__base"), F.expr(_matches("__text", CANDIDATE)).alias("__hits"))
    outside = "filter(__hits, h -> NOT exists(__base, b -> b.start < h.stop AND h.start < b.stop))"
    stepped = f"transform({outside}, h -> struct(h.start AS start, h.stop AS stop, {battery('h.match')} AS step, char_length(h.match) AS size))"
    return seen.withColumn("__maybe", F.expr(f"CASE WHEN size(__hits) > 0 THEN {stepped} END")).drop("__hits")


def _least_step(maybe: DataFrame, share: float) -> DataFrame:
    """One row: the step from which on strings are reported (none: null), by step-up control over all strings tested.

    Strings are weighted by length, with a mean weight of 1: a long string has
    more power to show that it is random, so the level is spent where it tells
    more.  Only counts per step are ordered, at most ``LAST_STEP`` of them.
    """
    tested = maybe.select(F.explode("__maybe").alias("m")).select("m.step", "m.size")
    weight = F.least(F.lit(4.0), F.greatest(F.lit(0.25), F.col("size") / 32))
    steps = tested.groupBy(F.greatest(F.coalesce("step", F.lit(0)), F.lit(0)).alias("step")).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    down = Window.orderBy(F.col("step").desc())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = steps.select("step", F.sum("n").over(down).alias("above"), F.sum("n").over(whole).alias("all"), F.sum("w").over(whole).alias("weight"))
    level = F.pow(F.lit(10.0), -F.col("step") / STEPS) * F.col("weight") / F.col("all")
    fits = (F.col("step") > 0) & (level <= share * F.col("above") / F.col("all"))
    return ranked.agg(F.min(F.when(fits, F.col("step"))).alias("__from"))


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__text", whole_text())


def _all_spans(least: str) -> Column:
    added = f"transform(filter(__maybe, m -> m.step >= {least}), m -> struct(m.start AS start, 3 AS kind, m.stop AS stop))"
    return F.expr(f"array_sort(concat(__base, coalesce({added}, slice(__base, 1, 0))))")


def _listed(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, s -> concat_ws(':', {names}[s.kind], s.start, s.stop)), ',')"


def scan(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """Counts and spans of secrets for every document, those of the fixed forms and those that the battery adds.

    An added span has the kind ``random`` and never overlaps one of a fixed
    form.  Null texts count as empty and have no spans; repeated rows and null
    ids are kept; an empty table gives no rows.  Only id and text are read.
    Texts are read once: what was found is stored, and the threshold that all
    documents give is applied to it.
    """
    plain = _with_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    seen = stored(_looked_at(plain, ["doc_id"]), "secrets")
    least = _least_step(seen, false_discoveries).first()["__from"]
    spans = seen.withColumn("__all", _all_spans("NULL" if least is None else str(least)))
    count = lambda k: F.expr(f"CAST(size(filter(__base, s -> s.kind = {k})) AS BIGINT)")
    return spans.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("__base")), 256).alias("base_sha256"),
        F.expr(_listed("__all")).alias("spans"),
    )


MASK = "[secret]"


def masked(docs: DataFrame, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """The documents with every secret replaced by a mark; columns stay, ``n_chars`` follows where there is one.

    Overlapping spans are replaced together.  Texts without secrets and null
    texts don't change.
    """
    plain = _with_text(docs)
    found = stored(_looked_at(plain.select("__text"), []), "secrets")
    least = _least_step(found, false_discoveries).first()["__from"]
    names = docs.columns
    seen = _looked_at(plain, names + ["__text"]).withColumn("__all", _all_spans("NULL" if least is None else str(least)))
    cut = f"""concat_ws('', aggregate(__all, struct(CAST(0 AS BIGINT) AS at, CAST(array() AS ARRAY<STRING>) AS parts),
      (s, x) -> CASE WHEN x.start >= s.at
        THEN struct(x.stop AS at, concat(s.parts, array(substring(__text, CAST(s.at + 1 AS INT), CAST(x.start - s.at AS INT)), '{MASK}')) AS parts)
        ELSE struct(greatest(s.at, x.stop) AS at, s.parts AS parts) END,
      s -> concat(s.parts, array(substring(__text, CAST(s.at + 1 AS INT))))))"""
    made = seen.withColumn("text", F.when(F.size("__all") > 0, F.expr(cut)).otherwise(F.col("text")))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        made = made.withColumn("n_chars", F.when(F.size("__all") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return made.select(*names)
