"""SQL equivalents (DuckDB) of the queries that SQL can express, meant for small tables."""

from __future__ import annotations

_RULES = """rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
    ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_MIX_WORDS = f"CAST(len({_WORDS}) AS BIGINT)"

ORACLES: dict[str, str] = {
    "op2_substring": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        g AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS t FROM s),
        hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY t) AS n FROM g) WHERE n > 1),
        gone AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS p FROM hit),
        lists AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r),
        k AS (SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
            CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]) END AS kept FROM d LEFT JOIN lists USING (r))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op3_suffix": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
        s AS (SELECT doc_id, unnest(range(0, octet_length(t) - 49)) AS i, t FROM d WHERE octet_length(t) >= 50),
        w AS (SELECT doc_id, i, md5(t[i + 1:i + 50]) AS k FROM s),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM w) WHERE least < doc_id),
        runs AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hit),
        marks AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM runs),
        spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM marks GROUP BY doc_id, run),
        pieces AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y, b - a AS n FROM spans),
        cut AS (SELECT p.doc_id, count(*) AS n_spans, sum(n) AS n_removed, string_agg(hex(t[x + 1:y]), '' ORDER BY x) AS kept, max(y + n) AS last
            FROM pieces p JOIN d ON p.doc_id = d.doc_id GROUP BY p.doc_id)
        SELECT d.doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
            sha256(CASE WHEN kept IS NULL THEN t ELSE unhex(kept || hex(t[last + 1:octet_length(t)])) END) AS kept_sha256
        FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id""",
    "op5_url_filter": rf"""
        WITH {_RULES},
        p AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
        m AS (SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
            FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (r)""",
    "op6_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT row_number() OVER () AS b, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
        bw AS (SELECT b, item, least(13, len(v)) AS n, v, unnest(range(1, len(v) - least(13, len(v)) + 2)) AS i FROM b WHERE len(v) > 0),
        win AS (SELECT DISTINCT b, item, n, array_to_string(v[i:i + n - 1], ' ') AS t FROM bw),
        lens AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
        hit AS (SELECT r, dw.n AS n, i, b, item FROM dw JOIN win ON win.n = dw.n AND win.t = array_to_string(w[i:i + dw.n - 1], ' ')),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, i + unnest(range(0, n)) AS p FROM hit) GROUP BY r),
        items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, b, item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op7_topk": """
        WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings),
        p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(list_sum(list_transform(range(1, len(c.bits) + 1), lambda i: abs(c.bits[i] - q.bits[i]))) AS INTEGER) AS distance
            FROM c, c AS q WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10""",
    "op10_mixing": f"""
        WITH d AS (SELECT doc_id, source, {_MIX_WORDS} AS size, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS o FROM documents),
        s AS (SELECT source, sum(size) AS n, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
        k AS (SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY n * 1.0 / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
            sum(w) OVER (ORDER BY n * 1.0 / w DESC, source DESC) AS ws FROM s),
        f AS (SELECT max(room / ws) AS unit FROM k WHERE room / ws * w <= 2 * n),
        t AS (SELECT source, n, CAST(least(2 * n, coalesce(unit, 1e300) * w) AS DOUBLE) AS target FROM k, f),
        a AS (SELECT source, n, target, CAST(floor(target + 0.5) AS BIGINT) AS amount FROM t),
        b AS (SELECT d.doc_id, d.size, CAST(a.n AS BIGINT) AS n, a.target, CASE WHEN a.n > 0 THEN a.amount // a.n ELSE 0 END AS passes, CASE WHEN a.n > 0 THEN a.amount % a.n ELSE 0 END AS rest,
            coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY o, d.size, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source)
        SELECT doc_id, size, n AS source_size, target, CAST(size * passes + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM b""",
    "op4_sharding": """
        WITH RECURSIVE step(k, c, n) AS (SELECT k, k, 0 FROM range(256) t(k) UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM step WHERE n < 8),
        crc AS (SELECT list(c ORDER BY k) AS crc_of FROM step WHERE n = 8),
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id, -4611686018427387904) AS id FROM documents),
        h AS (SELECT r, hex(encode(text)) AS h FROM d),
        sums AS (SELECT r, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
            lambda acc, b: xor(acc >> 8, crc_of[CAST(xor(acc, b) & 255 AS INTEGER) + 1])), 4294967295) AS crc FROM h, crc),
        k AS (SELECT d.*, strlen(text) + 1 AS size, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS key FROM d),
        g AS (SELECT key, id, sum(size) AS bytes FROM k GROUP BY key, id),
        b AS (SELECT key, id, bytes, coalesce(sum(bytes) OVER (ORDER BY key, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(bytes) OVER () AS total FROM g),
        s AS (SELECT key, id, CAST(list_sum(list_transform(range(1, 8), lambda i: CAST(2 * below + bytes >= i * total / 4.0 AS INTEGER))) AS INTEGER) AS shard FROM b),
        o AS (SELECT k.r, k.doc_id, k.size, k.key, k.id, s.shard FROM k JOIN s ON k.key = s.key AND k.id = s.id)
        SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY key >> 50, ((id % 16) + 16) % 16, key, id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM o JOIN sums USING (r)""",
}
