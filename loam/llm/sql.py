"""DuckDB SQL for the rows of the queries."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


#: CRC-32 byte by byte; DuckDB has no function for it.
CRC32 = f"""xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)),
            lambda a, x: xor(a >> 8, ({_crc_table()})[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"""

ORACLE = {
    "op1_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w)),
        later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        gone AS (SELECT doc_id, list(DISTINCT i + j) AS ps FROM later, range(20) t(j) GROUP BY doc_id),
        kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
            array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ps, k)) END, ' ') AS kept
            FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(kept) AS kept_sha256 FROM kept""",
    "op2_line_dedup": rf"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, k, ls[k] AS line, translate(trim(ls[k], {BLANKS}),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)),
        gone AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM l WHERE key NOT IN (SELECT key FROM gone) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op10_minhash_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", LOWER)} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (
            SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        pairs AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a),
        c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op4_quality_rules": rf"""
        WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
        r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) t(j) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
            WHERE len(trim(line, {BLANKS})) > 0 GROUP BY doc_id),
        m AS (SELECT w.doc_id, host, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
            len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
            FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
        h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM f GROUP BY host),
        p AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v, avg(1 / n) AS inv FROM h),
        s AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * inv, 1e-6) - 1, 1.0) AS s FROM p),
        verdict AS (SELECT host, (failed + m * s) / (n + s) AS rate FROM h, s)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
            CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept,
            round(rate, 9) AS host_rate
        FROM f JOIN verdict ON f.host IS NOT DISTINCT FROM verdict.host""",
    "op8_stratified_shards": rf"""
        WITH t AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, {CRC32} AS text_crc32 FROM documents),
        k AS (SELECT *, md5('loam|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(text_crc32 AS VARCHAR)) AS key FROM t),
        f AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY key, size) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS part FROM k),
        p AS (SELECT *, row_number() OVER (ORDER BY part, source NULLS LAST, key, size) AS place, count(*) OVER () AS n FROM f)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST((place * 8 - 1) // n AS INTEGER) AS shard,
            CAST(place - 1 - ((place * 8 - 1) // n) * n // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op6_mixing": rf"""
        WITH t AS (SELECT doc_id, source, len({WORDS}) AS size, ('0x' || md5('loam|' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:15])::BIGINT AS key FROM documents),
        z AS (SELECT source, sum(size) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM t GROUP BY source),
        f AS (SELECT *, 1.5 * sum(source_size) OVER () AS budget, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS rest, coalesce(sum(2 * source_size) OVER o, 0) AS filled
            FROM z WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT *, CASE WHEN 2 * source_size / weight > (budget - filled) / rest THEN (budget - filled) / rest END AS level FROM f),
        g AS (SELECT source, source_size, CASE WHEN level IS NULL THEN 2 * source_size ELSE weight * max(level) OVER () END::DOUBLE AS target FROM l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS rounds FROM g),
        c AS (SELECT t.*, r.source_size, target, rounds, sum(size) OVER (PARTITION BY t.source ORDER BY key) <= target - rounds * r.source_size AS again
            FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * least(rounds + again::INT, 2) AS BIGINT) AS taken FROM c""",
}
