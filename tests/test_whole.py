"""Queries that do the whole job beside those whose SQL states a part of it, against brute force on small fixtures."""

import datetime as dt
import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from burstline.config import Config
from burstline.operators import lsh
from burstline.plans import catalog

D1, D2 = dt.date(2012, 10, 9), dt.date(2012, 10, 10)
UNITS = 40


@pytest.fixture(scope="module")
def ring(spark, tmp_path_factory):
    """Forty units, each in three tweets of the first day (with its neighbours) and in one of the second: all of equal z."""
    texts = {D1: [" ".join(f"u{(k + j) % UNITS:02d}" for j in range(3)) for k in range(UNITS)], D2: [f"u{k:02d}" for k in range(UNITS)]}
    rows = [(f"{d:%d}-{k}", f"x{k}", t, dt.datetime(d.year, d.month, d.day, 2 * (k % 12)), d, k % 12, 0, None) for d, ts in texts.items() for k, t in enumerate(ts)]
    folder = tmp_path_factory.mktemp("ring")
    spark.createDataFrame(rows, "id_str string, user_id_str string, text string, ts timestamp, tw date, subtw int, retweet_count long, received_at timestamp").write.parquet(str(folder / "tweets.parquet"))
    return str(folder), texts[D1]


def test_pairs_of_all_units_of_the_budget(spark, ring):
    folder, texts = ring
    docs = [t.split() for t in texts]
    df = Counter(w for t in docs for w in t)
    vec = {u: Counter(w for t in docs if u in t for w in t) for u in df}
    vec = {u: {w: n * math.log(len(docs) // df[w]) for w, n in v.items()} for u, v in vec.items()}
    norm = {u: math.sqrt(sum(x * x for x in v.values())) for u, v in vec.items()}
    at = {u: k for k, u in enumerate(sorted(df))}
    want = {(at[a], at[b]): sum(vec[a][w] * vec[b][w] for w in vec[a].keys() & vec[b].keys()) / norm[a] / norm[b] for a, b in combinations(sorted(df), 2) if vec[a].keys() & vec[b].keys()}
    got = {(r["src"], r["dst"]): r["sim"] for r in catalog.QUERIES["pair_similarity_text"](spark, folder).collect()}
    assert got.keys() == want.keys() and max(b for _, b in got) == UNITS - 1
    assert all(got[p] == pytest.approx(want[p], abs=1e-6) for p in want)


@pytest.mark.parametrize("name,column", [("tfidf_vectors", "seg_id"), ("pair_similarity_g4", "src"), ("pair_similarity_g2", "src"), ("nearest_neighbours", "node"), ("mutual_neighbours", "node")])
def test_units_beyond_the_small_budget(spark, ring, name, column):
    assert max(r[column] for r in catalog.QUERIES[f"{name}"](spark, ring[0]).collect()) >= 25


def test_vectors_of_different_labels_meet(spark, tmp_path):
    """Queries are the ids divisible by 50; every other vector is compared with them."""
    rows = [(10 * k, [float(k % 3 == j) + 0.1 * (j == 3) for j in range(64)], f"l{k % 2}") for k in range(12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(str(tmp_path / "embeddings.parquet"))
    query = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    every = {(a, b) for a in (0, 50, 100) for b in range(0, 120, 10) if a != b}
    near = {(a, b) for a, b in every if a // 10 % 3 == b // 10 % 3}
    assert {(r["a"], r["b"]) for r in query("hamming_pairs")} == every
    got = query("cosine_pairs")
    assert len(got) == len(near) and {(r["a"], r["b"]) for r in got} == near
    assert {r["cos"]: r["n"] for r in query("similarity_histogram")} == {"1.0": len(near)}
    assert {r["node"]: r["component"] for r in query("vector_clusters")} == {10 * k: 10 * (k % 3) for k in range(12)}
    assert {r["node"]: r["component"] for r in query("lsh_clusters")} == {str(10 * k): min(str(10 * j) for j in range(k % 3, 12, 3)) for k in range(12)}


def test_recall_of_the_candidates(spark):
    """Near copies among five thousand vectors: at least 0.9 of the pairs with a cosine of 0.9 or more are found."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((4000, 64))
    copies = base[:1000] + 0.28 * rng.standard_normal((1000, 64))
    v = np.vstack([base, copies])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {tuple(sorted((str(i), str(j)))) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.9, 1)))}
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, v array<double>")
    c = Config()
    got = {(r["id_a"], r["id_b"]) for r in lsh.links(df, "id", "v", 64, c.lsh_similarity, c.lsh_bits, c.lsh_rounds, c.lsh_window).collect()}
    assert got <= want and len(want) > 900 and len(got) / len(want) >= 0.9


def test_lists_of_all_units_and_days(spark, ring, folder):
    assert len({r["unit"] for r in catalog.QUERIES["burst_two_list"](spark, ring[0]).collect()}) == UNITS
    assert [r["side"] for r in catalog.QUERIES["compare_lists"](spark, ring[0]).collect()] == ["both"] * UNITS
    turns = sorted((r["tw"], r["place"], r["system"]) for r in catalog.QUERIES["interleaved_lists"](spark, folder).collect())
    days = {tw for tw, _, _ in turns}
    assert len(days) > 1
    for day in days:
        assert [(p, s) for tw, p, s in turns if tw == day][:2] == [(1, "weight"), (2, "z")]
