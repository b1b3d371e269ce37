"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

OP10_LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, {SPACE}), {UPPER}, {LOWER}) AS key
  FROM (SELECT doc_id, unnest(split_parts) AS line, generate_subscripts(split_parts, 1) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS split_parts FROM documents))),
holders AS (SELECT key, min(doc_id) AS holder, count(DISTINCT doc_id) AS docs
            FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.*, coalesce(h.docs >= 2 AND l.doc_id > h.holder, false) AS dropped
           FROM lines l LEFT JOIN holders h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP1_SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS k
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS holder FROM starts GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM starts JOIN firsts USING (k) WHERE holder < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP4_SUFFIX_DEDUP = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
bytes AS (SELECT doc_id, i, x[2 * i + 1:2 * i + 2] AS byte,
                 CASE WHEN 2 * i + 400 <= length(x) THEN md5(x[2 * i + 1:2 * i + 400]) END AS k
          FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS i FROM docs)),
marked AS (SELECT *, k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 AS again FROM bytes),
covered AS (SELECT *, coalesce(max(CASE WHEN again THEN i END) OVER (
                PARTITION BY doc_id ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone FROM marked),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM covered),
per_doc AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed,
                   count(*) FILTER (WHERE first) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS left_
            FROM edges GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(left_, ''))) AS kept_sha256
FROM docs LEFT JOIN per_doc USING (doc_id)
"""

OP6_MINMAX_DEDUP = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {UPPER}, {LOWER})")} AS w
                        FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(list_slice(w, p, p + 2), ' '))) END AS s FROM docs),
sized AS (SELECT doc_id, len(s) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id
          HAVING 100 * count(*) >= 85 * ((SELECT n FROM sized WHERE doc_id = a.doc_id)
                                         + (SELECT n FROM sized WHERE doc_id = b.doc_id) - count(*))),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM sized UNION SELECT reach.doc_id, twoway.b FROM reach JOIN twoway ON twoway.a = reach.r),
roots AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN roots USING (doc_id)
"""


def _mixing() -> str:
    """The tree of budgets level by level, then each leaf's epochs and prefix."""
    domain = ("CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7') THEN 'web' "
              "WHEN source IN ('src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'forum' ELSE 'reference' END")
    weights = ["CASE k1 WHEN 'web' THEN 0.5::DOUBLE WHEN 'forum' THEN 0.3::DOUBLE WHEN 'reference' THEN 0.2::DOUBLE END",
               "CASE k2 WHEN 'en' THEN 0.55::DOUBLE WHEN 'de' THEN 0.2::DOUBLE WHEN 'fr' THEN 0.15::DOUBLE "
               "WHEN 'es' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END", "1.0::DOUBLE"]
    ctes = [f"""docs AS (SELECT doc_id, {domain} AS k1, coalesce(lang, chr(0)) AS k2, coalesce(source, chr(0)) AS k3,
                                len({WORDS}) AS n FROM documents)""",
            "leaves AS (SELECT k1, k2, k3, sum(n)::BIGINT AS tokens FROM docs GROUP BY ALL)"]
    for i, weight in enumerate(weights, 1):
        keys = [f"k{j}" for j in range(1, i + 1)]
        part = f"PARTITION BY {', '.join(keys[:-1])}" if i > 1 else ""
        budget = f"JOIN due{i - 1} USING ({', '.join(keys[:-1])})" if i > 1 else (
            "CROSS JOIN (SELECT sum(tokens)::BIGINT AS due FROM leaves)")
        ctes += [f"""nodes{i} AS (SELECT {', '.join(f'x.{k}' for k in keys)}, lim, due, {weight.replace(keys[-1], 'x.' + keys[-1])} AS weight
                     FROM (SELECT {', '.join(keys)}, 2 * sum(tokens)::BIGINT AS lim FROM leaves GROUP BY ALL) x {budget})""",
                 f"""shared{i} AS (SELECT *, (due - coalesce(sum(lim) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per
                     FROM nodes{i} WINDOW w AS ({part} ORDER BY lim / weight, {', '.join(keys)}))""",
                 f"""due{i} AS (SELECT {', '.join(keys)}, floor(least(lim::DOUBLE, greatest(max(per) OVER ({part}), 0) * weight)
                       + 1e-6)::BIGINT AS due FROM shared{i})"""]
    return f"""
WITH {', '.join(ctes)},
budgets AS (SELECT k1, k2, k3, CASE WHEN tokens > 0 THEN due // tokens ELSE 0 END AS epochs,
                   CASE WHEN tokens > 0 THEN due % tokens ELSE 0 END AS rest FROM leaves JOIN due3 USING (k1, k2, k3)),
drawn AS (SELECT docs.*, epochs, rest, ('0x' || md5('20:' || epochs || ':' || doc_id)[1:15])::BIGINT AS h
          FROM docs JOIN budgets USING (k1, k2, k3)),
placed AS (SELECT *, rest > 0 AND sum(n) OVER (PARTITION BY k1, k2, k3 ORDER BY h, doc_id) <= rest AS more FROM drawn)
SELECT doc_id, k1 AS domain, k2 AS lang, k3 AS source, unnest(range(0, (epochs + more::INT)::BIGINT))::INTEGER AS epoch, n AS n_tokens
FROM placed
"""


_LETTERS = "(VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E'))"

OP11_FILTER_AUDIT = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, {WORDS} AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                 (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                 + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > first)::INT AS mask
          FROM docs JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY ALL),
letters AS (SELECT * FROM {_LETTERS} x(i, c)),
orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [1 << a.i, 1 << b.i, 1 << c.i, 1 << d.i, 1 << e.i] AS bits
           FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[:step - 1]), 0)::INT AS earlier
          FROM orders, (SELECT unnest(range(1, 6))::INT AS step)),
taken AS (SELECT part, filter_order, step, f,
                 coalesce(sum(n) FILTER ((mask & (earlier | f)) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER ((mask & f) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER ((mask & f) > 0 AND (mask & earlier) > 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
                 coalesce(sum(good) FILTER ((mask & f) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(toxic) FILTER ((mask & f) > 0 AND (mask & earlier) = 0), 0)::BIGINT AS toxic_lost
          FROM counts, steps GROUP BY ALL)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM taken
"""

OP12_COLLOCATIONS = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                  translate(coalesce(text, ''), {UPPER}, {LOWER}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, w[i:i + k - 1] AS g, count(*) AS n FROM places GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS total FROM f WHERE len(g) = 1 GROUP BY lang),
phrases AS (SELECT lang, g, n AS a FROM f WHERE len(g) > 1 AND n >= 10),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM phrases),
scored AS (SELECT c.*, x.n AS l, y.n AS r, ((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n))::BIGINT AS score
           FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[:k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1:]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (SELECT lang, x AS g, max(a) AS most
           FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS x FROM phrases WHERE len(g) = 3) GROUP BY ALL),
listed AS (SELECT w.*, array_to_string(g, ' ') AS phrase FROM weakest w LEFT JOIN longer o USING (lang, g)
           WHERE len(g) = 3 OR most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total AS n, score
FROM listed JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def _tokens(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), {UPPER}, {LOWER}), "
            "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


OP13_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_tokens('text')} AS w FROM benchmark)),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS x
           FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM items WHERE k > 0)),
places AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS x
           FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs, (SELECT DISTINCT k FROM wanted))),
met AS (SELECT doc_id, k, p, item_id FROM places JOIN wanted USING (k, x)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM met) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN owners USING (doc_id)
"""


ORACLES = {
    "op1_substring_dedup": OP1_SUBSTRING_DEDUP, "op4_suffix_dedup": OP4_SUFFIX_DEDUP, "op6_minmax_dedup": OP6_MINMAX_DEDUP,
    "op7_mixing": _mixing(), "op10_line_dedup": OP10_LINE_DEDUP, "op11_filter_audit": OP11_FILTER_AUDIT,
    "op12_collocations": OP12_COLLOCATIONS, "op13_decontamination": OP13_DECONTAMINATION,
}
