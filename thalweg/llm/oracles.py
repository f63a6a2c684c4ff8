"""SQL, for another engine, with the results of the operators that SQL can express."""

from __future__ import annotations

from . import licenses, resampling, secrets, sharding, url_filters

#: The checksum's table and a text's bytes; a step of the checksum is one look-up.
CRC = """byte_table AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(0, 8)),
        lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(0, 256)) AS n)))"""


def rendezvous(shards: int = 40) -> str:
    """Every document with its size, checksum, shard, slot, and shard among one more."""
    digits = sharding.DIGITS
    return f"""WITH {CRC},
    d AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
    plain AS (SELECT doc_id, octet_length(encode(text)) + 16 AS size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(h) AS BIGINT) // 2),
                lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32
        FROM d, byte_table),
    bids AS (SELECT doc_id, s, ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || s), 1, {digits}) AS BIGINT) + 1)
        / {16**digits}.0) AS bid FROM (SELECT DISTINCT doc_id FROM documents), (SELECT unnest(range(0, {shards + 1})) AS s)),
    best AS (SELECT doc_id, arg_max(s, (bid, -s)) FILTER (WHERE s < {shards}) AS shard, arg_max(s, (bid, -s)) AS grown_shard
        FROM bids GROUP BY doc_id)
    SELECT p.doc_id, p.size, p.text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
        row_number() OVER (PARTITION BY shard ORDER BY p.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
    FROM plain p JOIN best b ON p.doc_id IS NOT DISTINCT FROM b.doc_id"""


def notices() -> str:
    """The licenses whose notices a document holds, by comparing every shingle of every notice."""
    known = licenses.notices(licenses.TEMPLATES)
    listed = ", ".join(f"({i}, '{n['name']}', '{' '.join(n['words'])}', {[f' {p} ' for p in n['required']]}::VARCHAR[])" for i, n in enumerate(known))
    before = ", ".join(f"({i}, {j})" for i, n in enumerate(known) for j in n["before"])
    grams = lambda w: f"list_transform(range(0, greatest(len({w}) - 4, 0)), lambda i: array_to_string({w}[i + 1 : i + 5], ' '))"
    return f"""WITH notice AS (SELECT id, name, required, len(string_split(words, ' ')) AS size, {grams("string_split(words, ' ')")} AS g
        FROM (VALUES {listed}) t(id, name, words, required)),
    before(id, part) AS (VALUES {before}),
    shingle AS (SELECT DISTINCT id, name, len(list_distinct(g)) AS n, unnest(g) AS s FROM notice),
    d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents),
    place AS (SELECT doc_id, unnest({grams("w")}) AS s, unnest(range(0, greatest(len(w) - 4, 0))) AS pos FROM d),
    held AS (SELECT doc_id, id, name, count(DISTINCT p.s) / CAST(any_value(n) AS DOUBLE) AS share, min(pos) AS word
        FROM place p JOIN shingle USING (s) GROUP BY doc_id, id, name),
    worded AS (SELECT held.*, notice.size FROM held JOIN notice USING (id) JOIN d USING (doc_id) WHERE share >= 0.8 - 1e-9
        AND len(list_filter(required, lambda p: NOT contains(concat(' ', array_to_string(w, ' '), ' '), p))) = 0),
    longest AS (SELECT * FROM worded x WHERE NOT EXISTS (SELECT 1 FROM worded y JOIN before ON before.id = y.id AND before.part = x.id
        WHERE y.doc_id = x.doc_id AND y.word <= x.word + x.size AND x.word <= y.word + y.size)),
    best AS (SELECT doc_id, name, max(share) AS share, arg_min(word, (-share, word)) AS word FROM longest GROUP BY doc_id, name)
    SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses,
        coalesce(string_agg(name || ':' || word || ':' || round(share, 3), ',' ORDER BY name), '') AS matches
    FROM d LEFT JOIN best ON best.doc_id = d.doc_id GROUP BY d.doc_id"""


def secret_spans() -> str:
    """The fixed forms, and the battery with its false-discovery control written over rows of characters."""
    q, tau = secrets.ORDINARY_EQUAL, secrets.ORDINARY_CHANGE
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    forms = [
        (k, quoted(p), f"regexp_extract_all(t, {quoted(p)}, {g})")
        for k, (p, g) in enumerate([(secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.CANDIDATE, 0)])
    ]
    hits = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS gaps, {part} AS part FROM d WHERE regexp_matches(t, {p})"
        for k, p, part in forms
    )
    per = lambda i: "CASE e " + " ".join(
        f"WHEN '{k}' THEN {v[i] if i == 2 else quoted(v[i])}" for k, v in secrets.ENCODINGS.items()
    ) + " END"
    names = "['" + "', '".join(secrets.KINDS) + "']"
    text = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    listed AS ({hits}),
    hit AS (SELECT r, kind, m, gaps, part, unnest(range(1, len(m) + 1)) AS i FROM listed),
    span AS (SELECT r, kind, m[i] AS s, length(part[i]) AS size, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM hit),
    placed AS (SELECT r, kind, s, size, start, start + length(s) AS stop FROM span),
    base AS (SELECT r, kind, start, stop FROM placed WHERE kind IN (1, 2) OR kind = 0 AND size >= {secrets.ASSIGN_LEAST}),
    token AS (SELECT row_number() OVER () AS k, r, s, start, stop, least(4.0, greatest(0.25, CAST(length(s) AS DOUBLE) / 32)) AS weight
        FROM placed p WHERE kind = 3
        AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = p.r AND b.start < p.stop AND p.start < b.stop)),
    coded AS (SELECT k, rtrim(s, '=') AS u, CASE WHEN regexp_full_match(s, '[0-9]+') THEN NULL
        WHEN regexp_full_match(s, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(s, '[A-Z2-7]+=*') THEN 'base32' ELSE 'base64' END AS e FROM token),
    one AS (SELECT k, e, u, unnest(range(1, length(u) + 1)) AS i FROM coded WHERE e IS NOT NULL),
    digit AS (SELECT k, e, i, greatest(strpos({per(0)}, substr(u, i, 1)), strpos({per(1)}, substr(u, i, 1))) AS v,
        CASE WHEN substr(u, i, 1) BETWEEN 'A' AND 'Z' THEN 1 WHEN substr(u, i, 1) BETWEEN 'a' AND 'z' THEN 2
             WHEN substr(u, i, 1) BETWEEN '0' AND '9' THEN 3 ELSE 4 END AS c FROM one),
    beside AS (SELECT *, lag(v) OVER w AS before, lag(c) OVER w AS c_before, avg(v) OVER (PARTITION BY k) AS mean FROM digit WINDOW w AS (PARTITION BY k ORDER BY i)),
    sums AS (SELECT k, any_value(e) AS e, CAST(count(*) AS DOUBLE) AS n, min(v) AS least_v, CAST(count(*) FILTER (WHERE c <> c_before) AS DOUBLE) AS changes,
        sum((v - mean) * (before - mean)) AS cov, sum((v - mean) * (v - mean)) AS var FROM beside GROUP BY k),
    squares AS (SELECT k, sum(o * o) AS oo FROM (SELECT k, v, count(*) AS o FROM digit GROUP BY k, v) GROUP BY k),
    read AS (SELECT k, n, changes, cov, var, CAST(length({per(0)}) AS DOUBLE) AS a, CAST({per(2)} AS DOUBLE) AS tau, oo
        FROM sums JOIN squares USING (k) WHERE least_v > 0 AND n >= 16 AND var > 0),
    off AS (SELECT *, a / n * oo - n AS chi FROM read),
    z AS (SELECT k, n, (chi - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n) AS zc,
        (changes - (n - 1) * tau) / sqrt((n - 1) * tau * (1 - tau)) AS zr, (cov / var + 1 / (n - 1)) * sqrt(n) AS zs,
        ((a + a * (n - 1) * {q} - n - chi) / sqrt(2 * a * a * (n - 1) / n * {q * (1 - q)})
            + (changes - (n - 1) * {tau}) / sqrt((n - 1) * {tau * (1 - tau)})) / sqrt(2) AS z FROM off),
    stepped AS (SELECT k, least({secrets.LAST_STEP}, floor({secrets.STEPS} * (CASE WHEN z <= 0.5 THEN 0.3
        ELSE (z * z / 2 + ln(z * 2.506628)) / ln(10) END + log10(least(4.0, greatest(0.25, n / 32)))))) AS step
        FROM z WHERE zc <= {secrets.BATTERY} AND abs(zr) <= {secrets.BATTERY} AND abs(zs) <= {secrets.BATTERY}),
    tested AS (SELECT token.*, step, greatest(coalesce(step, 0), 0) AS place FROM token LEFT JOIN stepped USING (k)),
    ranked AS (SELECT DISTINCT place, count(*) OVER (ORDER BY place DESC) AS above, count(*) OVER () AS n, sum(weight) OVER () AS w FROM tested),
    least_step AS (SELECT min(place) AS first FROM ranked WHERE place > 0 AND pow(10.0, -place / {secrets.STEPS}) * w / n <= {secrets.FALSE_DISCOVERIES} * above / n),
    everything AS (SELECT * FROM base UNION ALL SELECT r, 3, start, stop FROM tested, least_step WHERE step >= first)
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        sha256(coalesce(string_agg({text}, ',' ORDER BY start, kind, stop) FILTER (WHERE kind < 3), '')) AS base_sha256,
        coalesce(string_agg({text}, ',' ORDER BY start, kind, stop), '') AS spans
    FROM d LEFT JOIN everything x ON x.r = d.r GROUP BY d.r, d.doc_id"""


def url_verdicts() -> str:
    """Every url against every rule."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    hosts = ", ".join(
        f"({i}, {quoted(action)}, {quoted(rule)}, {quoted(rule.partition('/')[0])}, {quoted('/' + rule.partition('/')[2])})"
        for i, (action, rule) in enumerate(url_filters.HOST_RULES)
    )
    patterns = ", ".join(
        f"({i}, {quoted(action)}, {quoted(rule)}, {quoted(url_filters.pattern_rule(rule)[0])})" for i, (action, rule) in enumerate(url_filters.PATTERNS)
    )
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""WITH h(i, action, rule, host, path) AS (VALUES {hosts}), p(i, action, rule, regex) AS (VALUES {patterns}),
    given AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
    cut AS (SELECT r, page_id, translate(a, {letters}) AS whole, translate(regexp_extract(a, '^[^/?#]*'), {letters}) AS host,
        regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM given),
    by_host AS (SELECT r, arg_max(h.rule, (length(h.rule), h.action = 'block', -i)) AS rule, arg_max(h.action, (length(h.rule), h.action = 'block', -i)) AS action
        FROM cut JOIN h ON (cut.host = h.host OR suffix(cut.host, '.' || h.host)) AND starts_with(cut.path, h.path) GROUP BY r),
    by_pattern AS (SELECT r, arg_max(p.rule, (p.action = 'allow', -i)) AS rule, arg_max(p.action, (p.action = 'allow', -i)) AS action
        FROM cut JOIN p ON regexp_matches(whole, regex) GROUP BY r)
    SELECT page_id, host, path, by_host.rule AS rule, coalesce(by_host.action, by_pattern.action, 'allow') AS verdict, by_pattern.rule AS pattern
    FROM cut LEFT JOIN by_host USING (r) LEFT JOIN by_pattern USING (r)"""


def resampled() -> str:
    """Counts over the buckets of both tables, gains, weights and ranks."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = f"unnest(regexp_extract_all(translate(coalesce(text, ''), {letters}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
    count = resampling.BUCKETS
    return f"""WITH {CRC},
    d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    held AS (SELECT r, word, count(*) AS n FROM (SELECT r, {words} AS word FROM d) GROUP BY r, word),
    asked AS (SELECT word, count(*) AS n FROM (SELECT {words} AS word FROM benchmark) GROUP BY word),
    hashed AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, CAST(length(h) AS BIGINT) // 2),
                lambda i: CAST('0x' || substr(h, i * 2 + 1, 2) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % {count} AS bucket
        FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM held UNION SELECT word FROM asked)), byte_table),
    s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM held JOIN hashed USING (word) GROUP BY bucket),
    t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS n FROM asked JOIN hashed USING (word) GROUP BY bucket),
    gain AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + {count})
        / ((s.n + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + {count})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
    summed AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM held JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
    drawn AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        CAST('0x' || substr(sha256('{resampling.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN summed USING (r)),
    scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM drawn),
    ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {resampling.LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {resampling.PERCENT} // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)"""
