import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from burstline.llm import cooccur, terms


@pytest.mark.parametrize("text,found", [(None, None), ("", []), ("  ", []), ("The cat, the #dog!! it's ab ABC(def) \"xyz\"…", ["the", "cat", "the", "dog", "xyz"]), ("(wow)\twow\r\nwow x", ["wow", "wow"]), ("...", [])])
def test_terms(spark, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(terms.terms(F.col("t"))).first()[0] == found


def table(spark, rows):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], "id string, text string, term int")


def random_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["hot"] * 40 + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = [(str(k), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for k in range(n)]
    return rows + rows[:20] + [("x1", None), (None, "hot"), ("x2", ""), ("x3", "long " * 5000)]


def test_counts_against_a_counter(spark):
    rows = random_rows(400)
    recs = terms.records(table(spark, rows), "id", "text")
    got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_counts(terms.occurrences(recs, terms.terms("text"))).collect()}
    occ, docs = Counter(), Counter()
    for t in {k: t for k, t in rows if k and t}.values():
        occ.update(t.split())
        docs.update(set(t.split()))
    assert got == {t: (occ[t], docs[t]) for t in occ}


def test_scores_against_the_formula(spark):
    rows = random_rows(300, 2)
    recs = terms.records(table(spark, rows), "id", "text")
    texts = {k: (t or "").split() for k, t in rows if k}
    n = 100_000  # a number of records that makes no term frequent, and one that makes nearly all so
    for count in (n, 40):
        got = {(r["rec"], r["term"]): (r["tf"], r["kl"], r["tf_idf"]) for r in terms.distinctive_terms(recs, terms.terms("text"), F.lit(count)).collect()}
        cf, df = Counter(w for t in texts.values() for w in t), Counter(w for t in texts.values() for w in set(t))
        total = sum(cf.values())
        want = {}
        for k, t in texts.items():
            for w, tf in Counter(t).items():
                if df[w] >= 2:
                    pd, pc = (tf + 100 * cf[w] / total) / (len(t) + 100), cf[w] / total
                    want[k, w] = (tf, pd * math.log(pd / pc), tf * math.log(count / df[w]))
        assert got.keys() == want.keys()
        assert all(got[x] == pytest.approx(want[x]) for x in want)


def test_best_term_breaks_ties_by_name(spark):
    s = spark.createDataFrame([("a", "zz", 1.0), ("a", "bb", 1.0), ("a", "aa", 0.5)], "rec string, term string, s double")
    assert terms.best_term(s, "s").first()["term"] == "bb"


def test_empty_tables(spark):
    recs = terms.records(table(spark, []), "id", "text")
    assert terms.term_counts(terms.occurrences(recs, terms.terms("text"))).count() == 0
    assert terms.distinctive_terms(recs, terms.terms("text"), F.lit(0)).count() == 0


def test_stripes_against_pairs(spark):
    rng = random.Random(3)
    baskets = [sorted(set(["#hot"] * (k % 3 == 0) + rng.choices([f"@u{j}" for j in range(25)], k=rng.randint(0, 6)))) for k in range(600)] + [None, [], ["#one", None]]
    df = spark.createDataFrame([(b, "x") for b in baskets], "items array<string>, item string").repartition(5)
    n = len(baskets)
    got = {(r["item_a"], r["item_b"]): r for r in cooccur.together(df, "items", F.lit(n), min_count=3, significance=0.0, hold=50).collect()}
    single, pair = Counter(), Counter()
    for b in baskets:
        b = [x for x in b or [] if x]
        single.update(b)
        pair.update((x, y) for x in b for y in b if x < y)
    want = {p: c for p, c in pair.items() if c >= 3 and c * n > single[p[0]] * single[p[1]]}
    assert {p: r["n_ab"] for p, r in got.items()} == want
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"]) == (single[a], single[b]) and r["lift"] == pytest.approx(r["n_ab"] * n / (single[a] * single[b]))
        o = [[r["n_ab"], single[a] - r["n_ab"]], [single[b] - r["n_ab"], n - single[a] - single[b] + r["n_ab"]]]
        e = [[(o[i][0] + o[i][1]) * (o[0][j] + o[1][j]) / n for j in (0, 1)] for i in (0, 1)]
        assert r["llr"] == pytest.approx(2 * sum(o[i][j] * math.log(o[i][j] / e[i][j]) for i in (0, 1) for j in (0, 1) if o[i][j]), abs=1e-6)
