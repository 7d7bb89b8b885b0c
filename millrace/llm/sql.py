"""DuckDB twins of the training-data queries that SQL can express.

The others rest on trained models, tokenizers or robust estimates; their tests hold them against plain Python.
"""

_REACH = "r AS (SELECT a AS k, a AS v FROM l UNION SELECT r.k, l.b FROM r JOIN l ON l.a = r.v), c AS (SELECT k, min(v) AS root FROM r GROUP BY 1)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_robust_pruned_graph": f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
      l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM e p JOIN e q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9), {_REACH}
      SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, least(vec_id, coalesce(root, vec_id)) = vec_id AS kept
      FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id) LEFT JOIN c ON c.k = vec_id""",
    "op7_zip_warc_reader": """SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
      FROM (SELECT *, payload_bytes >= 100 AND page_id > first AS again FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))""",
    "op9_setsketch_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
      g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL
        UNION ALL SELECT doc_id, string_agg(w, ' ' ORDER BY i) FROM w WHERE n < 5 GROUP BY 1),
      n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)), {_REACH}
      SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(root, doc_id)) AS component_id, least(doc_id, coalesce(root, doc_id)) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.k = doc_id""",
}

_PLAIN = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_TEXT = "SELECT doc_id, coalesce(text, '') AS t FROM documents"


def _spans(k: int, kind: str, pattern: str, holds: str) -> str:
    """Matches of one kind of personal data with their places in code points; `holds` tests one, named m."""
    return f"""SELECT {k} AS k, '{kind}' AS kind, doc_id, m, s, s + length(m) AS e FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: length(array_to_string(ps[1:i], '')) + length(array_to_string(ms[1:i - 1], '')))) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d) WHERE len(ms) > 0) WHERE {holds}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({_DIGITS})[i]::INT
        WHEN reverse({_DIGITS})[i]::INT > 4 THEN 2 * reverse({_DIGITS})[i]::INT - 9 ELSE 2 * reverse({_DIGITS})[i]::INT END)) % 10 = 0"""
_CRC = """WITH RECURSIVE v AS (SELECT doc_id, 4294967295 AS c, doc_id::VARCHAR AS s, 0 AS i FROM documents
      UNION ALL SELECT doc_id, CASE WHEN i % 9 = 0 THEN xor(c, ascii(s[i // 9 + 1])::BIGINT) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, s, i + 1 FROM v WHERE i < 9 * length(s)),
      h AS (SELECT doc_id, xor(c, 4294967295) % 10 = 0 AS held_out FROM v WHERE i = 9 * length(s))"""

#: Twins of the parts of a query that SQL can express.
ORACLES |= {
    "lm_base_columns": f"""{_CRC}, w AS (SELECT doc_id, held_out, unnest(list_append({_WORDS}, '')) AS w FROM documents JOIN h USING (doc_id)),
      c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
      SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 6) AS base_score
      FROM w LEFT JOIN c USING (w), n GROUP BY 1""",
    "passage_spans": f"""WITH d AS ({_TEXT}), w AS (SELECT doc_id, unnest(ws) AS w, unnest(ps[:len(ws)]) AS p, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {_PLAIN} AS ws, string_split_regex(t, '[^\\x20\\x09-\\x0D]+') AS ps FROM d)),
      b AS (SELECT doc_id, i, sum(strlen(p)) OVER o + sum(strlen(w)) OVER o - strlen(w) AS s, sum(strlen(p)) OVER o + sum(strlen(w)) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
      r AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM (SELECT doc_id, {_PLAIN} AS ws FROM d) WHERE len(ws) >= 50)),
      l AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM r) WHERE k > 1),
      g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) + 50)::INT AS new FROM l)),
      m AS (SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM g GROUP BY doc_id, g)
      SELECT m.doc_id, (a - 1)::INT AS start_word, z::INT AS end_word, x.s::INT AS start_byte, y.e::INT AS end_byte FROM m JOIN b x ON x.doc_id = m.doc_id AND x.i = a JOIN b y ON y.doc_id = m.doc_id AND y.i = z""",
    "pii_base_columns": f"""WITH d AS ({_TEXT}), f AS (
      {_spans(0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
      UNION ALL {_spans(1, 'ip', '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', "list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255")}
      UNION ALL {_spans(2, 'card', '[0-9](?:[ -]?[0-9])+', f'length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}')}
      UNION ALL {_spans(3, 'phone', '[+][0-9][ ().0-9-]+[0-9]', f'length({_DIGITS}) BETWEEN 9 AND 15')})
      SELECT d.doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
        sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s), '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id) GROUP BY 1""",
    "quality_base_columns": f"""WITH d AS ({_TEXT}), w AS (SELECT doc_id, t, {_PLAIN} AS ws FROM d),
      k AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
      r AS (SELECT doc_id, count(DISTINCT i + x) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k), (VALUES (0), (1), (2)) v(x) WHERE n > 1 GROUP BY 1),
      l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
        SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
        FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))""",
}
