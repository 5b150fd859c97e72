"""DuckDB SQL that says the same as some of the queries, by plain definition."""

# The shortest run from and to every sentence: it has 21 sentences at most, since
# each has a word; the word sequences of all longer runs are made of theirs.
OP4 = r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '(?s).+?(?:[.!?]\s+|\n\s*|\z)') AS ps FROM documents),
  s AS (SELECT doc_id, i, ps[i] AS piece, trim(lower(regexp_replace(ps[i], '\s+', ' ', 'g'))) AS k FROM p, unnest(range(1, len(ps) + 1)) AS u(i)),
  x AS (SELECT doc_id, i, len(string_split(k, ' ')) AS wc, sum(len(string_split(k, ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS pw FROM s),
  c AS (SELECT a.doc_id, a.i, b.i AS j FROM x AS a JOIN x AS b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 20
    WHERE b.pw - a.pw + a.wc >= 50 OR (b.i > a.i AND b.pw - a.pw + a.wc >= 20)),
  j AS (SELECT doc_id, i, min(j) AS j FROM c GROUP BY doc_id, i UNION SELECT doc_id, max(i) AS i, j FROM c GROUP BY doc_id, j),
  l AS (SELECT doc_id, list(k ORDER BY i) AS ks FROM s GROUP BY 1),
  later AS (SELECT doc_id, i, j FROM j JOIN l USING (doc_id) QUALIFY row_number() OVER (PARTITION BY array_to_string(ks[i:j], chr(10)) ORDER BY doc_id, i) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM later),
  made AS (SELECT s.doc_id, count(gone.i) AS n, coalesce(string_agg(piece, '' ORDER BY s.i) FILTER (gone.i IS NULL), '') AS kept FROM s LEFT JOIN gone ON s.doc_id = gone.doc_id AND s.i = gone.i GROUP BY 1)
  SELECT documents.doc_id, CASE WHEN n > 0 THEN regexp_replace(kept, '\s+$', '') ELSE text END AS text FROM documents LEFT JOIN made USING (doc_id)"""

# Every run of several sentences: the pairs that follow each other make them up.
OP4_WHOLE = OP4.replace("BETWEEN a.i AND a.i + 20\n    WHERE b.pw - a.pw + a.wc >= 50 OR (b.i > a.i AND b.pw - a.pw + a.wc >= 20)", "= a.i + 1")

OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
  v AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first, [CAST('0x' || substr(d, 5 * g + 1, 5) AS INTEGER) FOR g IN range(0, 8)] AS fives FROM p)
  SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31) + 1, 1) FOR k IN range(0, 32)], '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM v"""

OP6_LOOKUP = r"""WITH k AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '')
    || coalesce(nullif(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), ''), '/') || lower(regexp_extract(url, '^[^?#]*(\?[^#]*)?', 1)) AS key FROM pages)
  SELECT a.url, count(*) AS captures, min(b.page_id) AS first_page, CAST(sum(b.page_id) AS BIGINT) AS page_sum
  FROM (SELECT DISTINCT url, key FROM k WHERE page_id % 100 = 0) AS a JOIN k AS b ON a.key = b.key GROUP BY 1"""

_CLASSES = """sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
  cls AS (SELECT a, min(b) AS m FROM reach GROUP BY 1), deg AS (SELECT a, count(*) AS n FROM sym GROUP BY 1)"""

OP8 = f"""WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM documents),
  g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS u(i) WHERE len(ws) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g AS x JOIN g AS y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM c JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 10 * k >= 8 * (p.n + q.n - k)), {_CLASSES}
  SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, coalesce(deg.n, 0) AS n_links, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
  FROM documents LEFT JOIN cls ON cls.a = doc_id LEFT JOIN deg ON deg.a = doc_id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v AS x JOIN v AS y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9), {_CLASSES}
  SELECT vec_id, coalesce(deg.n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
  FROM embeddings LEFT JOIN cls ON cls.a = vec_id LEFT JOIN deg ON deg.a = vec_id"""

OP10 = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, 3::DOUBLE * sum(size) AS cap FROM d GROUP BY 1),
  l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
  t AS (SELECT source, ss, least(cap, w * max(level) OVER ()) AS target FROM l),
  c AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss + 1e-12) ELSE 0 END AS copies FROM t), q AS (SELECT *, greatest(0, target - copies * ss) AS rest FROM c),
  z AS (SELECT source, size, CAST(floor(sqrt(size) * 1024) AS BIGINT) AS root, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
  f AS (SELECT z.source, size, root, rest - coalesce(sum(n * size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    CAST(sum(n * size * root) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS roots, CAST(sum(n * size) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS words
    FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source WINDOW w AS (PARTITION BY z.source ORDER BY size DESC)),
  m AS (SELECT source, max(size) AS top, arg_max(open / roots, size) AS factor, arg_max(least(open, words), size) AS due FROM f WHERE open / roots * root < 1 GROUP BY 1),
  h AS (SELECT q.*, coalesce(top, 0) AS top, coalesce(factor, 0) AS factor, coalesce(due, 0) AS due FROM q LEFT JOIN m ON q.source IS NOT DISTINCT FROM m.source),
  g AS (SELECT d.*, ss, target, copies, due, copies + CASE WHEN size > top THEN 1 ELSE 0 END AS sure, size > 0 AND size <= top AND due > 0 AS sampled, factor * CAST(floor(sqrt(size) * 1024) AS BIGINT) AS p FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
  r AS (SELECT *, CASE WHEN sampled THEN floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 1073741824) END AS rank FROM g),
  o AS (SELECT *, sampled AND coalesce(sum(size) OVER (PARTITION BY source, sampled ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= due AS inside FROM r),
  k AS (SELECT *, due - coalesce(sum(size) FILTER (inside) OVER (PARTITION BY source), 0) AS gap FROM o),
  e AS (SELECT *, sampled AND NOT inside AND abs(gap - size) < abs(gap) AS fits FROM k),
  x AS (SELECT *, fits AND row_number() OVER (PARTITION BY source, fits ORDER BY abs(gap - size), rank, doc_id, size) = 1 AS extra FROM e)
  SELECT doc_id, size, ss AS source_size, target, CAST(size * (sure + CASE WHEN inside OR extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x"""

OP11 = r"""WITH seen AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
  t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
  w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
  f AS (SELECT doc_id, part, len(ws) < 50 AS fa, 100 * len(list_distinct(ws)) < 65 * len(ws) AS fb,
    100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS fc, regexp_matches(x, '[#$%&*|]') AS fd, coalesce(doc_id > first, false) AS fe FROM w),
  cells AS (SELECT part, fa, fb, fc, fd, fe, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad, count(*) AS n FROM f LEFT JOIN seen ON seen.doc_id = f.doc_id GROUP BY ALL),
  l(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
  o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM l AS a, l AS b, l AS c, l AS d, l AS e
    WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND a.k <> e.k AND b.k <> c.k AND b.k <> d.k AND b.k <> e.k AND c.k <> d.k AND c.k <> e.k AND d.k <> e.k),
  m AS (SELECT part, good, bad, n, CASE WHEN fa THEN 'A' ELSE '' END || CASE WHEN fb THEN 'B' ELSE '' END || CASE WHEN fc THEN 'C' ELSE '' END
    || CASE WHEN fd THEN 'D' ELSE '' END || CASE WHEN fe THEN 'E' ELSE '' END AS fails FROM cells),
  s AS (SELECT part, good, bad, n, fails, filter_order, step, substr(filter_order, step, 1) AS k, contains(fails, substr(filter_order, step, 1)) AS here,
    length(regexp_replace(substr(filter_order, 1, step - 1), '[^' || fails || '.]', '', 'g')) > 0 AS past FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
  g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, k, CAST(sum(CASE WHEN NOT here AND NOT past THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN here AND NOT past THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN here AND past THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = k THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN here AND NOT past AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN here AND NOT past AND bad = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY 1, 2, 3, 4)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley FROM g"""

OP12 = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
  w AS (SELECT rid, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY 1, 2, 3), g AS (SELECT DISTINCT lang, source FROM d),
  v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 30),
  lq AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q FROM v),
  x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
  p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
  s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY 1, 2, 3),
  u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p.p - lq.q AS BIGINT) AS value FROM p JOIN lq ON lq.lang = p.lang AND lq.term = p.term WHERE p.n > 0 AND p.p > lq.q),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
  SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""

SQL = {
    "op4_substring_dedup": OP4,
    "op4_substring_dedup_whole": OP4_WHOLE,
    "op6_warc": OP6,
    "op6_warc_lookup": OP6_LOOKUP,
    "op8_ngram_jaccard_join": OP8,
    "op9_embedding_near_dedup": OP9,
    "op10_mixing": OP10,
    "op11_filter_interaction": OP11,
    "op12_source_divergence": OP12,
}
