"""The same queries as SQL, where SQL can say them."""

from __future__ import annotations

RECS = "recs AS (SELECT id_str AS rec, min(text) AS text FROM tweets WHERE id_str IS NOT NULL GROUP BY id_str)"
PIECES = r"""occ AS (
  SELECT rec, trim(piece, '.,!?;:()"''…#') AS term
  FROM (SELECT rec, unnest(string_split_regex(lower(text), '[ \t\r\n]+')) AS piece FROM recs)
  WHERE regexp_full_match(trim(piece, '.,!?;:()"''…#'), '[a-z]{3,}'))"""
N = "n AS (SELECT count(*) AS n FROM recs WHERE text IS NOT NULL)"
COUNTS = "counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM occ GROUP BY term)"
MARKED = "marked AS (SELECT counts.*, CASE WHEN records <= 2 THEN 'rare' WHEN records >= 0.02 * n THEN 'common' END AS mark FROM counts, n)"
SCORED = """tf AS (SELECT rec, term, count(*) AS tf FROM occ GROUP BY rec, term),
lens AS (SELECT rec, sum(tf) AS len FROM tf GROUP BY rec),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term),
total AS (SELECT sum(cf) AS c FROM stats),
scored AS (
  SELECT tf.rec, tf.term, tf.tf, stats.df, stats.cf::BIGINT AS cf, tf.tf * ln(n.n / stats.df) AS tf_idf,
    (tf.tf + 100.0 * stats.cf / total.c) / (lens.len + 100.0) AS pd, stats.cf / total.c AS pc
  FROM tf JOIN lens USING (rec) JOIN stats USING (term), n, total WHERE stats.df >= 2)"""
BASKETS = """one AS (
  SELECT id_str, list_distinct(list_filter(list_concat(
    list_transform(coalesce(max(hashtags), []), lambda x: '#' || lower(x.text)),
    list_transform(coalesce(max(user_mentions), []), lambda x: '@' || lower(x.screen_name))), lambda x: x IS NOT NULL)) AS items
  FROM tweets WHERE id_str IS NOT NULL GROUP BY id_str),
n AS (SELECT count(*) AS n FROM one),
it AS (SELECT id_str, unnest(items) AS item FROM one),
single AS (SELECT item, count(*) AS n_i FROM it GROUP BY item),
ab AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM it a JOIN it b ON a.id_str = b.id_str AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 6),
counted AS (SELECT ab.*, sa.n_i AS n_a, sb.n_i AS n_b, n.n FROM ab JOIN single sa ON sa.item = item_a JOIN single sb ON sb.item = item_b, n)"""
CELL = "CASE WHEN {o} > 0 THEN {o} * ln(({o})::DOUBLE / (({e})::DOUBLE)) ELSE 0.0 END"
G2 = "2.0 * (" + " + ".join(
    CELL.format(o=o, e=e)
    for o, e in (
        ("n_ab", "n_a * n_b / n"),
        ("(n_a - n_ab)", "n_a * (n - n_b) / n"),
        ("(n_b - n_ab)", "n_b * (n - n_a) / n"),
        ("(n - n_a - n_b + n_ab)", "(n - n_a) * (n - n_b) / n"),
    )
) + ")"

SQL = {
    "p2_counts": f"WITH {RECS}, {PIECES}, {N}, {COUNTS}, {MARKED} SELECT term, occurrences, records, mark FROM marked",
    "p2_found": f"WITH {RECS}, {PIECES}, {N}, {COUNTS}, {MARKED} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_scores": f"WITH {RECS}, {PIECES}, {N}, {SCORED} SELECT rec AS id_str, term, tf, df, cf, round(pd * ln(pd / pc), 6) AS kl, round(tf_idf, 6) AS tf_idf FROM scored",
    "p3_found": f"WITH {RECS}, {PIECES}, {N}, {SCORED} SELECT rec AS id_str, term FROM scored QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(tf_idf, 10) DESC, term) = 1",
    "p3_best_by_divergence": f"WITH {RECS}, {PIECES}, {N}, {SCORED} SELECT rec AS id_str, term FROM scored QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(pd * ln(pd / pc), 10) DESC, term) = 1",
    "p4_pairs": f"WITH {BASKETS} SELECT item_a, item_b, n_ab, n_a, n_b, round(n_ab * n / (n_a * n_b), 6) AS lift, round({G2}, 4) AS llr FROM counted WHERE {G2} >= 3.841 AND n_ab * n > n_a * n_b",
    "p4_found": f"WITH {BASKETS} SELECT item_a, item_b FROM counted WHERE n_ab * n >= 5 * n_a * n_b",
}
