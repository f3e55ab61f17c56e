"""The same results as the registered queries, as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from siltstone.llm.ring import VNODES
from siltstone.llm.urlfilter import LOWER, ORDER, UPPER

WORD = r"[^\x20\x09-\x0D]+"

MIXTURE = rf"""
    WITH RECURSIVE t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents),
    s AS (SELECT source, CAST(SUM(n_tokens) AS BIGINT) AS n FROM t GROUP BY 1),
    r AS (SELECT MIN(n) FILTER (n > 0) / MAX(n) AS r, SUM(n) AS total FROM s),
    b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
          SELECT i + 1, CASE WHEN POW(r, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN POW(r, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END FROM b, r WHERE i < 60),
    e AS (SELECT CASE WHEN POW(r, -1) > 2.0 THEN hi ELSE 0 END AS a, total FROM b, r WHERE i = 60),
    z AS (SELECT SUM(POW(n / total, a)) AS z FROM s, e WHERE n > 0),
    w AS (SELECT source, n, CASE WHEN n > 0 THEN POW(n / total, a) / z ELSE 0 END AS weight FROM s, e, z),
    g AS (SELECT *, CAST(ROUND(weight * (SELECT MAX(n / weight) FROM w WHERE weight > 0)) AS BIGINT) AS raw FROM w),
    p AS (SELECT source, n, weight, CASE WHEN n = 0 THEN 0 WHEN ABS(raw - n) <= 1 THEN n ELSE raw END AS tokens FROM g),
    q AS (SELECT *, CASE WHEN n > 0 THEN tokens // n ELSE 1 END AS whole, CASE WHEN n > 0 THEN tokens % n ELSE 0 END AS rest FROM p),
    k AS (SELECT GREATEST(1, CAST(CEIL(SUM(tokens) / 131072) AS BIGINT)) AS blocks FROM q),
    x AS (SELECT t.*, q.* EXCLUDE (source), unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
    h AS (SELECT *, CAST('0x' || substr(md5('1:' || epoch || ':' || doc_id), 1, 15) AS BIGINT) AS pos, CAST('0x' || substr(md5('1:' || epoch || ':' || doc_id), 16, 15) AS BIGINT) AS mixed FROM x),
    c AS (SELECT *, SUM(n_tokens) OVER (PARTITION BY source, epoch ORDER BY pos) - SUM(n_tokens) OVER (PARTITION BY source, epoch, pos) AS inside FROM h),
    y AS (SELECT *, CAST(CASE WHEN tokens > 0 THEN LEAST(FLOOR((epoch * n + inside) * blocks / tokens), blocks - 1) ELSE ((pos >> 20) * blocks) >> 40 END AS BIGINT) AS block
          FROM c, k WHERE epoch < whole OR inside < rest)
    SELECT doc_id, source, n_tokens, ROUND(weight, 9) AS weight, epoch, CAST(epoch * n + inside AS BIGINT) AS start, block,
           CAST(ROW_NUMBER() OVER (PARTITION BY block ORDER BY mixed, doc_id, source, epoch, n_tokens) AS INT) AS place FROM y"""

REVISITS = r"""
    WITH p AS (SELECT page_id, url, html, sha256(COALESCE(html, '')) AS tag, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest,
               page_id * 2 + 2 * (CAST('0x' || substr(md5(COALESCE(url, '')), 1, 8) AS BIGINT) % 997) + 1 AS later FROM pages),
    u AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS site,
               regexp_replace(regexp_replace('&' || regexp_extract(rest, '\?(.*)$', 1), '&(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '^&|&$', '', 'g') AS query FROM p),
    k AS (SELECT *, CASE WHEN contains(url, '://') THEN site || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE url END AS url_key FROM u),
    f AS (SELECT a.page_id, MAX(b.page_id) AS found FROM k a JOIN k b ON a.url_key = b.url_key AND b.page_id * 2 < a.later GROUP BY 1)
    SELECT k.page_id * 2 + 1 AS record_id, k.url_key, k.later AS ts, s.page_id * 2 AS source_id, s.page_id * 2 AS source_ts,
           CASE WHEN s.page_id IS NULL THEN 'orphan' WHEN s.tag = k.tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
           CASE WHEN s.tag = k.tag THEN 200 ELSE 304 END AS status,
           CASE WHEN s.tag = k.tag THEN 'content-length=' || COALESCE(strlen(s.html), 0) || ';content-type=text/html' ELSE 'content-length=0' END || ';date=' || k.later || ';etag=' || k.tag AS headers
    FROM k LEFT JOIN f ON f.page_id = k.page_id LEFT JOIN k s ON s.page_id = f.found"""


def url_ratio(rules: list[tuple[str, str]]) -> str:
    fits = ""
    for rule, what in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits += f" WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{rule}'"
    ruled = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{w}'" for r, w in rules) + " END"
    p = {}
    for side in "ar":
        p[side] = "1.0 / 33"
        for k in range(1, ORDER + 1):
            p[side] = f"(COALESCE(n{k}.{side}, 0) + 5.0 * ({p[side]})) / (COALESCE(c{k}.{side}, 0) + 5.0)"
    joins = ""
    for k in range(1, ORDER + 1):
        tail = f"substr(g, {ORDER + 1 - k}, {k})"
        joins += f" LEFT JOIN n n{k} ON n{k}.k = {k} AND n{k}.x = {tail} LEFT JOIN c c{k} ON c{k}.k = {k} AND c{k}.x = substr({tail}, 1, {k - 1})"
    return rf"""
    WITH u AS (SELECT page_id, translate(regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(COALESCE(url, ''), '(?s)^.*?://([^#]*)', 1) AS seen FROM pages),
    r AS (SELECT *, CASE{fits} END AS rule, regexp_replace(regexp_replace(translate(seen, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '(?s)[^a-z0./_-]', '~', 'g') AS norm FROM u),
    v AS (SELECT *, {ruled} AS ruled FROM r),
    q AS (SELECT norm, COUNT(CASE WHEN ruled = 'allow' THEN 1 END) AS acc, COUNT(CASE WHEN ruled = 'block' THEN 1 END) AS rej FROM v GROUP BY 1),
    t AS (SELECT norm, acc, rej, substr('^^^' || norm || '$', CAST(i AS BIGINT), {ORDER}) AS g FROM q, LATERAL (SELECT unnest(range(1, length(norm) + 2)) AS i)),
    d AS (SELECT g, SUM(acc) AS a, SUM(rej) AS r FROM t GROUP BY 1),
    o AS (SELECT unnest(range(1, {ORDER + 1})) AS k),
    n AS (SELECT k, substr(g, CAST({ORDER + 1} - k AS BIGINT), k) AS x, SUM(a) AS a, SUM(r) AS r FROM d, o WHERE a + r > 0 GROUP BY 1, 2),
    c AS (SELECT k, substr(x, 1, k - 1) AS x, SUM(a) AS a, SUM(r) AS r FROM n GROUP BY 1, 2),
    l AS (SELECT g, LN({p['a']}) - LN({p['r']}) AS llr FROM d{joins}),
    s AS (SELECT norm, ANY_VALUE(acc) AS acc, ANY_VALUE(rej) AS rej, AVG(llr) AS score FROM t JOIN l USING (g) GROUP BY 1),
    b AS (SELECT GREATEST(-1000, LEAST(1000, FLOOR(score * 100))) AS bin, SUM(acc) AS acc, SUM(rej) AS rej FROM s WHERE acc + rej > 0 GROUP BY 1),
    m AS (SELECT bin, ROUND(1 - COALESCE(SUM(acc) OVER w, 0) / SUM(acc) OVER () + COALESCE(SUM(rej) OVER w, 0) / SUM(rej) OVER (), 9) AS gain, SUM(acc) OVER () AS a, SUM(rej) OVER () AS r
          FROM b WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    th AS (SELECT bin / 100 AS least FROM m WHERE a > 0 AND r > 0 ORDER BY gain DESC, bin LIMIT 1)
    SELECT page_id, host, path, rule, COALESCE(ruled, CASE WHEN score >= (SELECT least FROM th) THEN 'allow' ELSE 'block' END) AS verdict, ROUND(score, 6) AS score FROM v JOIN s USING (norm)"""


NEAR_DUPLICATES = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM l),
    s AS (SELECT doc_id, unnest(s) AS s FROM l),
    k AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
    d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    c AS (SELECT DISTINCT a, a AS b FROM d UNION SELECT c.a, d.b FROM c JOIN d ON c.b = d.a),
    m AS (SELECT a, MIN(b) AS m FROM c GROUP BY 1)
    SELECT n.doc_id, n.n AS n_shingles, COALESCE(m, n.doc_id) AS component_id, n.doc_id = COALESCE(m, n.doc_id) AS kept FROM n LEFT JOIN m ON m.a = n.doc_id"""


def _crc_of_nibble(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ 0xEDB88320 * (n & 1)
    return n


def _crc_in_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, half a byte at a time."""
    nibbles = rf"list_transform(regexp_extract_all(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '.'), lambda c: strpos('0123456789ABCDEF', c) - 1)"
    steps = [_crc_of_nibble(n) for n in range(16)]
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {nibbles}), lambda c, b: xor(c >> 4, {steps}[(xor(c, b) & 15) + 1])), CAST(4294967295 AS BIGINT))"


def ring_shards(shards: int) -> str:
    """Round after round: every row still without a shard asks the first point clockwise of a shard that has room."""
    key = lambda x, at: f"CAST('0x' || substr(md5({x}), {at}, 15) AS BIGINT)"

    def turn(k: int) -> str:
        before = f"""
    l{k} AS MATERIALIZED (SELECT * FROM o{k - 1} WHERE NOT fits),
    m{k} AS MATERIALIZED (SELECT m.shard, room - COUNT(o.shard) AS room, filled + COUNT(o.shard) AS filled FROM m{k - 1} m LEFT JOIN o{k - 1} o ON o.shard = m.shard AND fits GROUP BY m.shard, room, filled),"""
        return before * (k > 0) + f"""
    p{k} AS MATERIALIZED (SELECT p.* FROM points p JOIN m{k} m ON m.shard = p.shard WHERE room > 0),
    h{k} AS MATERIALIZED (SELECT l.* EXCLUDE (shard, fits, slot), COALESCE(p.shard, (SELECT arg_min(shard, spot) FROM p{k})) AS shard FROM l{k} l ASOF LEFT JOIN p{k} p ON l.spot <= p.spot),
    n{k} AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY priority, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) AS n FROM h{k}),
    o{k} AS MATERIALIZED (SELECT n.* EXCLUDE (n), n <= room AS fits, filled + n - 1 AS slot FROM n{k} n JOIN m{k} m ON m.shard = n.shard)"""

    chain = ",".join(turn(k) for k in range(shards))
    every = " UNION ALL ".join(f"SELECT doc_id, size, text_crc32, shard, slot FROM o{k} WHERE fits" for k in range(shards))
    return rf"""
    WITH points AS MATERIALIZED (SELECT {key("'1:' || shard || ':' || v", 1)} AS spot, CAST(shard AS INT) AS shard FROM range({shards}) a(shard), range({VNODES}) b(v)),
    l0 AS MATERIALIZED (SELECT doc_id, CAST(COALESCE(strlen(text), 0) + 16 AS BIGINT) AS size, {_crc_in_sql('text')} AS text_crc32,
        {key("'1:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')", 1)} AS spot, {key("'1:' || COALESCE(CAST(doc_id AS VARCHAR), 'null')", 16)} AS priority, 0 AS shard, false AS fits, 0 AS slot FROM documents),
    m0 AS MATERIALIZED (SELECT CAST(shard AS INT) AS shard, n // {shards} + CASE WHEN shard < n % {shards} THEN 1 ELSE 0 END AS room, 0 AS filled FROM range({shards}) a(shard), (SELECT COUNT(*) AS n FROM documents)),{chain}
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM ({every})"""


#: Equal words q apart, taken together where they follow one another: every maximal stretch of every period.
WORD_RUNS = rf"""
    WITH t AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS rn, doc_id, regexp_extract_all(COALESCE(text, ''), '{WORD}') AS words, COALESCE({_crc_in_sql("CAST(doc_id AS VARCHAR)")}, 1) AS h FROM documents),
    u AS MATERIALIZED (SELECT rn, doc_id, h, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN h // 10 % len(words) END AS a FROM t),
    v AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM u),
    raw AS MATERIALIZED (SELECT rn, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
    w AS MATERIALIZED (SELECT r.rn, r.i, COALESCE(o.word, r.word) AS word FROM raw r JOIN v ON v.rn = r.rn LEFT JOIN raw o ON o.rn = r.rn AND r.i >= v.a AND o.i = v.a + (r.i - v.a) % v.p),
    e AS (SELECT x.rn, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.rn = y.rn AND x.word = y.word AND x.i < y.i),
    s AS (SELECT rn, q, MIN(i) AS s, COUNT(*) + q AS l FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY rn, q ORDER BY i) AS g FROM e) GROUP BY rn, q, g),
    r AS MATERIALIZED (SELECT rn, s, l, MIN(q) AS q FROM s WHERE l >= 12 AND l >= 2 * q GROUP BY rn, s, l),
    best AS (SELECT rn, COUNT(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), (-l, s, q)) AS b, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY rn),
    gone AS (SELECT DISTINCT w.rn, w.i FROM w JOIN r ON r.rn = w.rn AND w.i >= r.s + r.q AND w.i < r.s + r.l),
    kept AS (SELECT rn, string_agg(word, ' ' ORDER BY i) AS rest FROM w ANTI JOIN gone USING (rn, i) GROUP BY rn)
    SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period, CAST(1000 * b.l // b.q AS BIGINT) AS exponent_milli,
           sha256(COALESCE(listed, '')) AS runs_sha256, sha256(COALESCE(rest, '')) AS collapsed_sha256
    FROM u LEFT JOIN best USING (rn) LEFT JOIN kept USING (rn)"""
