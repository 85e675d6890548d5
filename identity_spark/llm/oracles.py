"""SQL for DuckDB that gives the rows of the registered queries, by plain brute force."""

from __future__ import annotations

from . import decontamination, secrets, sharding

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links of all pairs of sets that share a shingle, and their closure.
JACCARD = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
    x AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w WHERE len(ws) >= 4),
    y AS (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS x FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    g AS (SELECT DISTINCT doc_id, x FROM y WHERE x IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
    u AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM g),
    s AS (SELECT doc_id, coalesce(max(u.n), 0) AS n FROM w LEFT JOIN u USING (doc_id) GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS n, any_value(b.n) AS m FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (n + m - shared)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(x.least_id, doc_id)) AS component_id FROM s LEFT JOIN (SELECT a, min(b) AS least_id FROM r GROUP BY 1) x ON x.a = s.doc_id
"""


def sharding_sql(n_shards: int, seed: int = 20_240_601) -> str:
    """Row numbers, sent through the rounds of the permutation until they are below the row count."""
    rounds = ""
    for k, (m, c) in enumerate(sharding.round_keys(seed)):
        of, to, size = ("r", "l", "a") if k % 2 == 0 else ("l", "r", "b")
        t = f"(({of} * {m} + {c}) % {sharding.PRIME})"
        rounds += f", k{k} AS (SELECT i, a, b, n, {', '.join(f'({x} + {t} * {t} % {sharding.PRIME}) % {size} AS {x}' if x == to else x for x in 'lr')} FROM {f'k{k - 1}' if k else 'h'})"
    once = f"WITH h AS (SELECT i, a, b, n, p // b AS l, p % b AS r FROM {{0}}){rounds} SELECT i, a, b, n, l * b + r AS p FROM k{len(sharding.round_keys(seed)) - 1}"
    return rf"""
    WITH RECURSIVE poly AS (SELECT range AS v FROM range(256)),
    steps(v, x, k) AS (SELECT v, CAST(v AS UBIGINT), 0 FROM poly UNION ALL SELECT v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, k + 1 FROM steps WHERE k < 8),
    crc AS (SELECT list(x ORDER BY v) AS t FROM steps WHERE k = 8),
    d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
    y AS (SELECT doc_id, octet_length(raw) AS bytes, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: CAST('0x' || x AS UBIGINT)) AS bs FROM d),
    z AS (SELECT doc_id, bytes + 8 AS size, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, o: xor(c >> 8, t[CAST(xor(c, o) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) AS BIGINT) AS text_crc32 FROM y, crc),
    num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_number, count(*) OVER () AS n FROM z),
    dom AS (SELECT n, arg_min(x, ((x - n % x) % x, -x)) AS a FROM (SELECT DISTINCT n FROM num) q, LATERAL (SELECT unnest(range(greatest(1, least(2, CAST(floor(sqrt(n)) AS BIGINT)), CAST(floor(sqrt(n)) AS BIGINT) // 2, CAST(floor(sqrt(n)) AS BIGINT) - 100000), CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS x) e GROUP BY n),
    start AS (SELECT row_number AS i, a, greatest(1, (num.n + a - 1) // a) AS b, num.n, row_number AS p FROM num JOIN dom ON dom.n = num.n),
    walk(i, a, b, n, p) AS (SELECT * FROM ({once.format("start")}) f UNION ALL SELECT * FROM ({once.format("(SELECT * FROM walk WHERE p >= n) again")}) g)
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % {n_shards} AS INT) AS shard, p // {n_shards} AS slot, CAST(NULL AS INT) AS grown_shard, row_number FROM num JOIN walk ON walk.i = num.row_number WHERE p < walk.n
    """


def secrets_sql() -> str:
    """Matches and the texts between them, rule by rule; starts are sums of their lengths."""
    parts = []
    for k, rule in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
        # either case of ASCII letters only
        head = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in "password passwd secret token api_?key".split()) + ")"
        pattern = rule.pattern.replace("((?i:password|passwd|secret|token|api_?key))", head).replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS rule, '{rule.kind}' AS kind, unnest(range(1, len(found) + 1)) AS i, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS found, unnest(taken) AS taken, {rule.least} AS least FROM
          (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS taken FROM d) x WHERE len(found) > 0""")
    kinds = [r.kind for r in secrets.BASE_RULES]
    text = lambda only: f"coalesce(string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, rule){only}, '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({" UNION ALL ".join(parts)}),
    p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS e FROM m),
    h AS (SELECT doc_id, rule, kind, CAST(e - length(found) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE length(taken) >= least),
    o AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)}, {text(f" FILTER (rule < {len(kinds)})")} AS base, {text("")} AS spans FROM h GROUP BY 1)
    SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
    """


def decontamination_sql() -> str:
    """Every word of every document beside every equal word of every item, counted along diagonals in windows."""
    wide, least = decontamination.WINDOW, decontamination.LEAST_WORDS
    words = lambda table, key: rf"(SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS n FROM (SELECT {key}, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+') AS ws FROM {table}) x)"
    return f"""
    WITH b AS {words("benchmark", "item_id")}, d AS {words("documents", "doc_id")},
    m AS (SELECT d.doc_id, b.item_id, b.n, b.i, d.i - b.i AS diagonal FROM d JOIN b ON b.w = d.w),
    c AS (SELECT doc_id, item_id, n,
      CASE WHEN i <= n - {wide} THEN count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i RANGE BETWEEN CURRENT ROW AND {wide - 1} FOLLOWING)
        ELSE count(*) FILTER (i >= n - {wide}) OVER w END AS shared
      FROM m WINDOW w AS (PARTITION BY doc_id, item_id, diagonal)),
    f AS (SELECT doc_id, item_id, max(shared) AS shared FROM c WHERE shared >= CASE WHEN n < {least} THEN n WHEN n < {wide} THEN n - n * {decontamination.SUBSTITUTIONS} // {wide} ELSE {wide - decontamination.SUBSTITUTIONS} END GROUP BY 1, 2),
    o AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(shared) AS shared_words FROM f GROUP BY 1)
    SELECT t.doc_id, o.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, coalesce(shared_words, 0) AS shared_words FROM documents t LEFT JOIN o USING (doc_id)
    """


def clustering_sql(k: int, rounds: int, dim: int) -> str:
    """Rounds of plain k-means, each a step of its own: nearest centroids, then means rounded down."""
    at = """d{r} AS MATERIALIZED (SELECT vec_id, n, e, cluster, d FROM (
            SELECT *, row_number() OVER (PARTITION BY n ORDER BY d, cluster) AS place FROM (
                SELECT vec_id, n, e, cluster, CAST(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{r})) WHERE place = 1)"""
    mean = """c{s} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{r} LEFT JOIN (
            SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                SELECT cluster, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM d{r}, range(1, {end}) AS t(i) GROUP BY cluster, i) GROUP BY cluster) USING (cluster))"""
    steps = [x.format(r=r, s=r + 1, end=dim + 1) for r in range(rounds) for x in (at, mean)] + [at.format(r=rounds)]
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
              WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT CAST(place - 1 AS INTEGER) AS cluster, e AS c FROM (SELECT e, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), e) AS place FROM v) WHERE place <= {k}),
        {", ".join(steps)}
        SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM d{rounds} JOIN c{rounds} USING (cluster)
    """
