"""DuckDB SQL that gives the same rows as the queries of this package."""

from __future__ import annotations

from tallyweave.llm.source_mixing import MIX_SHARE, MIX_WEIGHTS

BLOCK_NAMES_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


WINDOWS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dn AS (SELECT r, doc_id, w, greatest(len(w) - 4, 1) AS m FROM d WHERE len(w) > 0),
bn AS (SELECT item, item_id, w, greatest(len(w) - 4, 1) AS n FROM b WHERE len(w) > 0),
ds AS (SELECT r, doc_id, m, p, w[p + 1 : p + 5] AS s FROM dn, unnest(range(m)) AS t(p)),
bs AS (SELECT item, item_id, n, w[p + 1 : p + 5] AS s FROM bn, unnest(range(n)) AS t(p)),
bc AS (SELECT item, item_id, n, s, count(*) AS c FROM bs GROUP BY ALL),
hit AS (SELECT r, doc_id, m, item, item_id, n, least(m, n) AS size, p, s, c FROM ds JOIN bc USING (s)),
win AS (SELECT r, doc_id, item, item_id, n, size, s, c, start FROM hit, unnest(range(greatest(p - size + 1, 0), least(p, m - size) + 1)) AS t(start)),
per AS (SELECT r, doc_id, item, item_id, n, size, start, s, least(count(*), any_value(c)) AS k FROM win GROUP BY r, doc_id, item, item_id, n, size, start, s),
o AS (SELECT r, doc_id, item, item_id, n, size, start, CAST(sum(k) AS BIGINT) AS o FROM per GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS windows, CAST(min(start) AS INTEGER) AS first_word, max(round(o / (n + size - o), 6)) AS similarity
FROM o WHERE 100 * o >= 80 * (n + size - o) GROUP BY r, doc_id, item, item_id
"""


def _mixing(weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int = 4, seed: int = 42) -> str:
    """The same budgets by rounds of filling, and prefixes by one running sum per leaf."""
    levels = ["domain", "language", "source_name"]

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights[level].items())
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    steps, parent = [], "(SELECT CAST(sum(tokens) AS BIGINT) * {0} // {1} AS up FROM leaf)".format(*share)
    for depth, level in enumerate(levels, 1):
        keys = ", ".join(levels[:depth])
        above = ", ".join(levels[: depth - 1])
        part = f"PARTITION BY {above}" if above else ""
        order = f"{part} ORDER BY cap / w, {level}"
        ahead = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        join = f"JOIN (SELECT {above}, own AS up FROM b{depth - 1}) USING ({above})" if above else f"CROSS JOIN {parent}"
        steps.append(f"""
n{depth} AS (SELECT {keys}, CAST(sum(tokens) AS BIGINT) * {epochs} AS cap, {weight(level)} AS w FROM leaf GROUP BY {keys}),
f{depth} AS (SELECT *, greatest(CAST(up AS HUGEINT) - coalesce(sum(cap) {ahead}, 0), 0) AS l, sum(w) OVER ({part}) - coalesce(sum(w) {ahead}, 0) AS ws
             FROM n{depth} {join}),
g{depth} AS (SELECT *, max(CASE WHEN cap * ws <= w * l THEN 0 ELSE 1 END) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM f{depth}),
h{depth} AS (SELECT *, max(CASE WHEN opened = 1 THEN l END) OVER ({part}) AS pool, max(CASE WHEN opened = 1 THEN ws END) OVER ({part}) AS total FROM g{depth}),
i{depth} AS (SELECT *, CASE WHEN opened = 1 THEN w * pool // total ELSE cap END AS base,
             sum(opened) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM h{depth}),
j{depth} AS (SELECT *, pool - sum(CASE WHEN opened = 1 THEN base END) OVER ({part}) AS lost FROM i{depth}),
b{depth} AS (SELECT {keys}, CAST(least(base + CASE WHEN opened = 1 AND place <= lost THEN 1 ELSE 0 END, cap) AS BIGINT) AS own FROM j{depth})""")
    return rf"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens,
           coalesce('domain' || CAST(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) // 5 AS VARCHAR), '~') AS domain,
           coalesce(lang, '~') AS language, coalesce(source, '~') AS source_name FROM documents),
leaf AS (SELECT domain, language, source_name, sum(tokens) AS tokens FROM d WHERE tokens > 0 GROUP BY ALL),
{",".join(steps)},
p AS (SELECT d.*, b3.own AS leaf_budget, b3.own // leaf.tokens AS passes, b3.own % leaf.tokens AS rest
      FROM d JOIN leaf USING (domain, language, source_name) JOIN b3 USING (domain, language, source_name) WHERE d.tokens > 0),
q AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, source_name
      ORDER BY md5('{seed}:' || CAST(passes AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '~')), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM p)
SELECT doc_id, domain, language, source_name, tokens, CAST(passes + CASE WHEN ahead < rest THEN 1 ELSE 0 END AS BIGINT) AS copies, leaf_budget FROM q
"""


def _licences() -> str:
    from tallyweave.llm.licence_digests import KNOWN, SPELLINGS

    known = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)

    def canonical(text: str) -> str:
        line = r"(?im)^[^\n\w]*(copyright|\(c\)|©).*(\d{4}|\(c\)|©|\ball rights reserved\b).*$"
        out = rf"regexp_replace(coalesce({text}, ''), '{line}', '', 'g')"
        out = rf"' ' || trim(regexp_replace(lower({out}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"
        for said, meant in SPELLINGS:
            out = f"replace({out}, ' {said} ', ' {meant} ')"
        return f"trim({out})"

    return f"""
WITH k AS (SELECT DISTINCT licence_id, {canonical("text")} AS form FROM (VALUES {known}) AS v(licence_id, text)),
u AS (SELECT doc_id, 'document' AS unit, text FROM documents
      UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
f AS (SELECT doc_id, unit, {canonical("text")} AS form FROM u)
SELECT doc_id, unit, licence_id, count(*) AS hits FROM f JOIN k USING (form) WHERE form <> '' GROUP BY ALL
"""


LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT r, count(*) FILTER (WHERE s.key IS NOT NULL) AS n_dropped,
      string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL) AS kept FROM k LEFT JOIN s USING (key) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN m USING (r)
"""


PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9), 'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9) || ' ') AS t FROM documents),
p AS MATERIALIZED (SELECT row_number() OVER () AS p, lang, piece FROM (SELECT lang, unnest(string_split(t, chr(10))) AS piece FROM d)),
w AS MATERIALIZED (SELECT p, lang, w, i FROM (
    SELECT p, lang, unnest(words) AS w, unnest(range(len(words))) AS i FROM (SELECT p, lang, string_split(piece, ' ') AS words FROM p)) WHERE w <> ''),
s AS MATERIALIZED (SELECT lang, w AS a, lead(w) OVER x AS b, lead(w, 2) OVER x AS c, lead(w, 3) OVER x AS d FROM w WINDOW x AS (PARTITION BY p ORDER BY i)),
f AS MATERIALIZED (
    SELECT lang, a AS g, 1 AS m, count(*) AS f FROM s GROUP BY ALL
    UNION ALL SELECT lang, a || ' ' || b, 2, count(*) FROM s WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3, count(*) FROM s WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d, 4, count(*) FROM s WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, g, m, f, string_split(g, ' ') AS v FROM f WHERE m >= 2 AND f >= 30),
held AS MATERIALIZED (SELECT lang, array_to_string(v[i : i + k - 1], ' ') AS g, max(f) AS longer
    FROM c CROSS JOIN (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) AS a(k, i) WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
named AS MATERIALIZED (SELECT lang || chr(10) || g AS name, f FROM f),
cut AS MATERIALIZED (SELECT lang, g, f AS a, k, lang || chr(10) || array_to_string(v[1 : k], ' ') AS left_part, lang || chr(10) || array_to_string(v[k + 1 : m], ' ') AS right_part
    FROM c CROSS JOIN (VALUES (1), (2), (3)) AS a(k) WHERE k < m),
scored AS (SELECT cut.lang, cut.g, cut.a, k, l.f AS l, r.f AS r, CAST(2000000 * CAST(cut.a AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
    FROM cut JOIN named AS l ON l.name = left_part JOIN named AS r ON r.name = right_part),
best AS (SELECT lang, g, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM scored GROUP BY lang, g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best LEFT JOIN held USING (lang, g) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""


def _clusters(dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3") -> str:
    """Every vector beside every centroid, round after round; means are floored also where they are negative."""

    def nearest(of: str) -> str:
        return f"""SELECT vec_id, any_value(v) AS v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
    SELECT x.r, x.vec_id, x.v, c.cluster, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM x CROSS JOIN {of} AS c) GROUP BY r, vec_id"""

    steps = []
    for i in range(rounds):
        steps.append(f"""
a{i} AS MATERIALIZED ({nearest(f"c{i}")}),
m{i} AS (SELECT cluster, d, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT cluster, unnest(v) AS e, unnest(range({dims})) AS d FROM a{i}) GROUP BY cluster, d),
g{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, CAST(coalesce(g{i}.v, c{i}.v) AS BIGINT[]) AS v FROM c{i} LEFT JOIN g{i} USING (cluster))""")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{salt}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS INTEGER) AS cluster, v
    FROM x ORDER BY cluster LIMIT {k}),
{",".join(steps)},
z AS MATERIALIZED ({nearest(f"c{rounds}")})
SELECT z.vec_id, cluster, z.distance, CAST(sum(z.distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(z.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM z JOIN c{rounds} AS c USING (cluster)
"""


def urls_sql(rules: list[tuple[str, str]], start: float = 0.5, strength: float = 2.0, deviations: float = 1.645, least: float = 0.5) -> str:
    """Three levels of shrinkage, one after the other; hosts here are names of two or three labels under suffixes of one."""
    fits = lambda base, path: f"((host = '{base}' OR ends_with(host, '.{base}')) AND starts_with(path, '{path}'))"
    cases = lambda said: " ".join(
        f"WHEN {fits(text.partition('/')[0], '/' + text.partition('/')[2])} THEN '{said(text, verdict)}'"
        for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])))
    steps = []
    for name, keys, parent in (("s", "suffix", "m"), ("d", "suffix, domain", "s"), ("h", "domain, host", "d")):
        prior = "(SELECT m FROM whole)" if parent == "m" else "p.share"
        join = "" if parent == "m" else f"JOIN {parent}4 AS p USING ({keys.split(', ')[0]})"
        steps.append(f"""
{name}1 AS (SELECT {keys}, sum(n) AS n, sum(g) AS g FROM c GROUP BY ALL),
{name}2 AS (SELECT {name}1.*, {prior} AS prior FROM {name}1 {join}),
{name}3 AS (SELECT 1 / least(greatest(coalesce(CASE WHEN t > k THEN (s - k) / (t - k) END, 0.5), 0.001), 0.5) - 1 AS x FROM (
    SELECT sum(n * pow(g / n - prior, 2) / (prior * (1 - prior))) AS s, count(*) AS k, sum(n) AS t FROM {name}2 WHERE n > 0)),
{name}4 AS (SELECT {keys.split(', ')[-1]}, n, (g + x * prior) / (n + x) AS share, n + x AS total FROM {name}2, {name}3)""")
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
o AS (SELECT page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM p
      JOIN labels ON labels.doc_id = TRY_CAST(regexp_extract(path, '^/[a-z]+/(\d{{1,18}})', 1) AS BIGINT) GROUP BY page_id),
c AS (SELECT regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '[^.]*(\.[^.]*)?$') AS domain, host,
      count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS g FROM p LEFT JOIN o USING (page_id) GROUP BY ALL),
whole AS (SELECT (coalesce(sum(g), 0) + {strength * start}) / (coalesce(sum(n), 0) + {strength}) AS m FROM c),
{",".join(steps)},
b AS (SELECT host, n, share - {deviations} * sqrt(share * (1 - share) / (total + 1)) AS bound FROM h4)
SELECT page_id, host, path, CASE {cases(lambda text, verdict: text)} END AS rule,
       CASE {cases(lambda text, verdict: verdict)} WHEN bound >= {least} THEN 'allow' ELSE 'block' END AS verdict,
       CAST(n AS BIGINT) AS labelled, round(bound, 6) AS bound
FROM p JOIN b USING (host)
"""


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
      list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
      'abcdefghijklmnopqrstuvwxyz' || repeat(' ', 5)), ' '), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, hash(g) AS h, md5(g) AS g FROM (SELECT r, array_to_string(w[i + 1 : i + 5], ' ') AS g
      FROM (SELECT r, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS MATERIALIZED (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.h = b.h AND a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM pairs JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.r = d.r JOIN d AS o ON o.r = reach.other GROUP BY d.r, d.doc_id
"""


LICENCE_SQL = _licences()
CLUSTERS_SQL = _clusters()
MIXING_SQL = _mixing(MIX_WEIGHTS, MIX_SHARE)
