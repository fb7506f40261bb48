"""DuckDB SQL for those queries of this subpackage that SQL can express."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ITEM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

def _clustering(rounds: int = 10) -> str:
    """Seeds, `rounds` rounds of assignment and whole-number means, and the last assignment, as one query."""
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INT) AS j, x FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT 8))",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT vec_id, v.x, j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v CROSS JOIN c{i} c)")
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, j, CAST(d AS BIGINT) AS d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, j) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT j, p, sum(e) AS s, count(*) AS n FROM (SELECT j, unnest(x) AS e, unnest(range(1, 65)) AS p FROM a{i}) GROUP BY j, p)")
            parts.append(f"m{i} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s{i} GROUP BY j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.j = c.j)")
    last = f"SELECT vec_id, a.j AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.j"
    return f"WITH {', '.join(parts)} {last}"


ORACLE: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM documents),
 sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM words)),
 sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
 common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
 pairs AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
 reach(doc, other) AS (SELECT x, y FROM pairs UNION SELECT r.doc, b.y FROM reach r JOIN pairs b ON r.other = b.x),
 least AS (SELECT doc, min(other) AS other FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON least.doc = d.doc_id""",
    "op4_rlz": f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
 windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
 firsts AS (SELECT h, min(doc_id) AS f FROM windows GROUP BY h),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE f < doc_id),
 left_over AS (SELECT t.doc_id, string_agg(t.word, ' ' ORDER BY t.p) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) t ANTI JOIN gone g ON g.doc_id = t.doc_id AND g.p = t.p GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM words w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = w.doc_id LEFT JOIN left_over k ON k.doc_id = w.doc_id""",
    "op7_decontamination": f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOW}, {_ITEM}) AS w FROM documents),
 items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, {_ITEM}) AS w FROM benchmark),
 patterns AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)),
 windows AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words CROSS JOIN (SELECT DISTINCT n FROM patterns))),
 found AS (SELECT doc_id, i, w.n, item FROM windows w JOIN patterns p ON p.p = w.p AND p.n = w.n),
 hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM found) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM words w LEFT JOIN hit h ON h.doc_id = w.doc_id LEFT JOIN named n ON n.doc_id = w.doc_id""",
    "op11_collocations": f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
 grams AS (SELECT lang, m AS size, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces CROSS JOIN (SELECT unnest(range(1, 5)) AS m))),
 counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
 totals AS (SELECT lang, sum(f) AS n FROM counts WHERE size = 1 GROUP BY lang),
 frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
 cuts AS (SELECT lang, phrase, size, f AS a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1)),
 scores AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, 2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS score FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.lp JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rp),
 lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 inner_parts AS (SELECT lang, f, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, f, w, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM frequent WHERE size > 2))),
 longest AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY lang, phrase),
 kept AS (SELECT s.* FROM lowest s LEFT JOIN longest g ON g.lang = s.lang AND g.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT k.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000""",
    "op12_centroids": _clustering(),
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
