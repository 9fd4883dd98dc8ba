"""DuckDB SQL for the operators whose results SQL can express, written from their contracts."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
f AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source) AS k, sum(3 * n) OVER (ORDER BY 3.0 * n / w, source) AS full_size, sum(w) OVER () - sum(w) OVER (ORDER BY 3.0 * n / w, source) AS free_w, sum(n) OVER () AS total FROM s),
-- The number of sources that are held at three times their size, and what is left for the others.
c AS (SELECT min(a.k) - 1 AS held FROM f a WHERE 3.0 * a.n / a.w >= (a.total - a.full_size + 3 * a.n) / CAST(a.free_w + a.w AS DOUBLE)),
l AS (SELECT coalesce((SELECT CAST(total - full_size AS DOUBLE) FROM f, c WHERE k = held), (SELECT CAST(any_value(total) AS DOUBLE) FROM f)) AS rest, coalesce((SELECT free_w FROM f, c WHERE k = held), (SELECT sum(w) FROM s)) AS by_w),
t AS (SELECT source, n, CASE WHEN k <= held THEN 3.0 * n ELSE rest * w / by_w END AS target FROM f, c, l),
g AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, CAST(floor(target / n) AS BIGINT)) END AS whole FROM t),
r AS (SELECT d.*, g.n, g.target, g.whole, g.target - g.whole * g.n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS same FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target,
       CAST(size * least(3, whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - same <= rest AND upto - rest < rest - (upto - same))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

_HOST = rf"""
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
x AS (SELECT DISTINCT host, path FROM v),
rules AS (SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) AS q(rule, h, p, says)),
y AS (SELECT x.host, x.path, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM x LEFT JOIN rules ON (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p) GROUP BY ALL)"""


def _models() -> str:
    """Interpolated estimates of both models, order by order, for every code of the scored URLs."""
    out = ["p0 AS (SELECT DISTINCT code, 1.0 / 32 AS a, 1.0 / 32 AS b FROM codes)"]
    for k in range(1, 5):
        n, m = 32**k, 32 ** (k - 1)
        out += [
            f"g{k} AS (SELECT code % {n} AS g, CAST(count(CASE WHEN says = 'allow' THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN says = 'block' THEN 1 END) AS DOUBLE) AS b FROM train GROUP BY 1)",
            f"h{k} AS (SELECT (code // 32) % {m} AS h, CAST(count(CASE WHEN says = 'allow' THEN 1 END) AS DOUBLE) AS a, CAST(count(CASE WHEN says = 'block' THEN 1 END) AS DOUBLE) AS b FROM train GROUP BY 1)",
            f"p{k} AS (SELECT p.code, (coalesce(g.a, 0) + 2.0 * p.a) / (coalesce(h.a, 0) + 2.0) AS a, (coalesce(g.b, 0) + 2.0 * p.b) / (coalesce(h.b, 0) + 2.0) AS b FROM p{k - 1} p LEFT JOIN g{k} g ON p.code % {n} = g.g LEFT JOIN h{k} h ON (p.code // 32) % {m} = h.h)",
        ]
    return ",\n".join(out)


def _op2(fold: str) -> str:
    """fold: SQL that tells whether a URL is set aside for the cut (DuckDB has no crc32, so it is given as a table)."""
    return rf"""
WITH {_HOST},
sy AS (SELECT *, list_concat(list_concat([0, 0, 0], list_transform(list_filter(string_split(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789_', 'abcdefghijklmnopqrstuvwxyz000000000-'), ''), lambda c: c <> ''), lambda c: CASE WHEN strpos('abcdefghijklmnopqrstuvwxyz0/.-~', c) > 0 THEN strpos('abcdefghijklmnopqrstuvwxyz0/.-~', c) ELSE 31 END)), [0]) AS s FROM y),
codes AS (SELECT host, path, says, unnest(list_transform(range(4, len(s) + 1), lambda i: s[i - 3] * 32768 + s[i - 2] * 1024 + s[i - 1] * 32 + s[i])) AS code FROM sy),
folded AS ({fold}),
train AS (SELECT codes.says, code FROM codes JOIN folded USING (host, path) WHERE codes.says IS NOT NULL AND NOT aside),
{_models()},
score AS (SELECT host, path, round(avg(ln(p4.a / p4.b)), 9) AS score FROM codes JOIN p4 USING (code) GROUP BY ALL),
bins AS (SELECT floor(least(greatest(score, -8.0), 8.0) * 64) AS bin, count(CASE WHEN says = 'allow' THEN 1 END) AS a, count(CASE WHEN says = 'block' THEN 1 END) AS b FROM y JOIN score USING (host, path) JOIN folded USING (host, path) WHERE says IS NOT NULL AND aside GROUP BY 1),
worth AS (SELECT bin, coalesce(sum(b) OVER lower, 0) / nullif(sum(b) OVER (), 0) - coalesce(sum(a) OVER lower, 0) / nullif(sum(a) OVER (), 0) AS j FROM bins WINDOW lower AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (SELECT coalesce((SELECT bin / 64.0 FROM worth WHERE j IS NOT NULL ORDER BY j DESC, abs(bin), bin LIMIT 1), 0.0) AS cut)
SELECT page_id, v.host, v.path, rule, coalesce(says, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN y USING (host, path) JOIN score USING (host, path), cut"""


#: A fifth of the URLs is set aside by an md5, which both engines have.
OP2 = _op2("SELECT host, path, ('0x' || substr(md5(host || path), 1, 7))::BIGINT % 5 = 0 AS aside FROM y")

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = d.doc_id"""

OP9 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM w WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 19], ' ')) AS h FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM h),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE k > 1),
k AS (SELECT w.doc_id, i, w.w[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w.w) + 1)) AS i) AS t WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = w.doc_id AND g.i = t.i)),
a AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(a.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.t, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)"""


def _op12() -> str:
    """Trees by recursion over levels; a step of a proof is a run's text with _ for the node itself. crc32 is worked out bit by bit."""
    part = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295, {bits}), lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)))"

    def levels(name: str, base: str) -> str:
        return f"{name} AS ({base} UNION ALL SELECT level + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, source, i // 16, n)"

    def steps(name: str, nodes: str) -> str:
        beside = lambda sign: f"coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i {sign} x.i), '')"
        return f"""{name} AS (SELECT x.level, x.source, x.i, {beside("<")} || '_' || {beside(">")} AS step FROM {nodes} x
            JOIN {nodes} y ON x.level = y.level AND x.source IS NOT DISTINCT FROM y.source AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY x.level, x.source, x.i)"""

    return f"""WITH RECURSIVE
    d AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOWER.format("text"))} END AS bent FROM documents),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
    {levels("t", "SELECT 0 AS level, source, i, n, leaf AS h FROM l")},
    s AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
    {levels("o", "SELECT 0 AS level, '' AS source, i, n, h FROM s")},
    {steps("a", "t")},
    {steps("b", "o")},
    p AS (SELECT l.source, l.i, list(a.step ORDER BY a.level) AS path FROM l JOIN a ON l.source IS NOT DISTINCT FROM a.source AND a.i = l.i // CAST(16 ** a.level AS BIGINT) GROUP BY l.source, l.i),
    q AS (SELECT s.source, list(b.step ORDER BY b.level) AS path FROM s JOIN b ON b.i = s.i // CAST(16 ** b.level AS BIGINT) GROUP BY s.source),
    r AS (SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM o WHERE n = 1) AS root, coalesce(l.bent, l.leaf) AS now, list_concat(p.path, q.path) AS path
        FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source LEFT JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.i = p.i LEFT JOIN q ON l.source IS NOT DISTINCT FROM q.source),
    f AS (SELECT doc_id, leaf, subroot, root, sha256(replace(coalesce(array_to_string(path, ''), ''), '_', '')) AS proof_sha256, list_reduce(list_prepend(now, path), lambda h, step: sha256(replace(step, '_', h))) AS folded_root FROM r)
    SELECT *, folded_root = root AS verified FROM f"""


OP12 = _op12()


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1, "op2_url_filter": OP2, "op3_near_dedup": OP3, "op9_substring_dedup": OP9, "op12_merkle_manifest": OP12}
