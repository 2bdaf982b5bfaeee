import random

import numpy as np
import pyarrow as pa
import pytest

from burstline.llm import neardup as N


@pytest.mark.parametrize("text,words", [(None, []), ("", []), ("  !! ", []), ("The «CAT», the cat! (ｃａｔ) 3-4 naïve", ["3-4", "cat", "naïve", "the"])])
def test_word_set(text, words):
    assert N.word_set(text) == words


def brute(rows, p):
    sets = {k: set(N.word_set(t)) for k, t in rows if k is not None}
    sets = {k: s for k, s in sets.items() if len(s) >= p.min_words}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= p.threshold * len(sets[a] | sets[b]) - 1e-9}


def random_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)]
    rows, base = [], []
    for k in range(n):
        if base and rng.random() < 0.5:
            ws = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            rng.shuffle(ws)
        else:
            ws = rng.sample(vocabulary, rng.randint(5, 20))
        base.append(ws)
        rows.append((f"{k:05}", " ".join(ws)))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "id string, text string, sid int, words int")


def test_pairs_against_brute_force(spark):
    rows = random_rows(500, 1)
    rows += rows[:30] + [(f"c{k}", rows[3][1].upper() + " word399 word398 word397 word396 word395") for k in range(5)] + [("n1", None), ("n2", ""), (None, rows[0][1]), ("long", " ".join(f"v{k}" for k in range(20_000)))]
    p = N.Params()
    got = [(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, rows), "id", "text", p).collect()]
    want = brute(rows, p)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 200 and len(set(got)) / len(want) >= 0.99


def test_hot_keys_lose_nothing(spark):
    """A template that many texts share: its band keys hold more sets than `hot`, and the exact way takes over."""
    base = [f"t{k}" for k in range(12)]
    rows = [(f"{k:04}", " ".join([*base, f"a{k}"])) for k in range(60)]
    p = N.Params(hot=10)
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, rows), "id", "text", p).collect()}
    assert got == brute(rows, p) and len(got) == 60 * 59 // 2


def test_a_key_of_half_the_sets_does_not_fill_its_bucket(spark):
    """Half of the sets share a template, and with it band keys: a key sends at most `hot` + 1 entries from each flush to its
    bucket, the other sets are known to be hot without it, and no pair is lost."""
    base = [f"t{k}" for k in range(30)]
    rows = [(f"{k:04}", " ".join([*base, f"a{k}"])) for k in range(150)] + [(f"{k:04}", " ".join(f"w{k}x{j}" for j in range(10))) for k in range(150, 300)]
    p = N.Params(hot=10)
    sets = N.distinct_sets(table(spark, rows), "id", "text", p).repartition(1)
    blobs = sets.select("g", N._hashes("words").alias("hs")).mapInArrow(N._band_blobs(16, p), "bucket int, hot boolean, blob binary").collect()
    entries = [len(r["blob"]) // 9 for r in blobs if not r["hot"]]
    assert sum(entries) <= 24 * (150 + 20 * (p.hot + 1)) and max(entries) < 24 * 150 and any(r["hot"] for r in blobs)
    got = {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, rows), "id", "text", p).collect()}
    assert got == brute(rows, p) and len(got) == 150 * 149 // 2


def test_groups(spark):
    rows = random_rows(200, 5)
    rows += [(f"c{k}", rows[0][1]) for k in range(3)]
    p = N.Params()
    got = {r["id"]: r for r in N.near_duplicate_groups(table(spark, rows), "id", "text", p).collect()}
    parent = {k: k for k in got}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, rows), "id", "text", p).collect()}:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {k: r["group_id"] for k, r in got.items()} == {k: root(k) for k in got}
    assert set(got) == {k for k, t in rows if len(N.word_set(t)) >= 8}


def test_empty_table(spark):
    assert N.near_duplicate_pairs(table(spark, []), "id", "text").count() == 0


def test_registers_and_chance():
    assert N.registers(np.array([2**63, 2**62, 2**62 + 2**61, 1], np.uint64), 4).tolist() == [0, 16, 24, 63 * 16]
    rng = np.random.default_rng(1)
    n, m, k = 12, 20, 4000
    a, b = (N.registers(rng.integers(0, 2**63, (k, x), dtype=np.uint64).min(axis=1) * np.uint64(2), 5, 7) for x in (n, m))
    assert abs((a == b).mean() - N._by_chance(5, 7)[n, m]) < 0.01


def shuffled(df):
    """Rows of the result, and how many rows its exchanges wrote, each exchange once."""
    rows, found = df.collect(), {}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "ReusedExchangeExec":
            return walk(node.child())
        metrics = node.metrics()
        if metrics.contains("shuffleRecordsWritten"):
            found[node.id()] = metrics.apply("shuffleRecordsWritten").value()
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, sum(found.values())


def test_sets_that_meet_by_chance_do_not_travel(spark):
    """Texts of usual words meet in numbers that grow with the square of the table, though no two are near."""
    rng = random.Random(3)
    rows = [(f"{k:05}", " ".join([*(f"usual{j}" for j in rng.sample(range(20), 10)), *(f"w{k}x{j}" for j in range(4))])) for k in range(1500)]
    p = N.Params()
    got, written = shuffled(N.similar_sets(N.distinct_sets(table(spark, rows), "id", "text", p), len(rows), p))
    assert got == [] and written < 2 * len(rows)


def test_ids_rule_out_no_near_pair(spark):
    rows = random_rows(400, 9) + [(f"long{k}", " ".join(f"v{j}" for j in range(k % 3, 60 + k))) for k in range(12)]
    p = N.Params()
    ids = {r["rep"]: r["g"] for r in N.distinct_sets(table(spark, rows), "id", "text", p).collect()}
    most, near = N._apart_table(p.threshold), {(a, b) for a, b in brute(rows, p) if a in ids and b in ids}
    apart = {(a, b): (ids[a] ^ ids[b]) >> 16 for a, b in near}
    assert len(near) > 200 and all(x.bit_count() <= most[ids[a] >> 10 & 63, ids[b] >> 10 & 63] for (a, b), x in apart.items())


def test_different_sets_of_one_id(spark):
    """Two near sets whose ids are equal are a pair like any other, with the prefix filter, too."""
    base = " ".join(f"t{j}" for j in range(30))
    sets = N.distinct_sets(table(spark, [(f"{k:06}", f"{base} a{k}") for k in range(2000)]), "id", "text", N.Params())
    by_id = {}
    for r in sets.select("g", "rep", "words").collect():
        by_id.setdefault(r["g"], []).append((r["rep"], r["words"]))
    rows = sorted(next(x for x in by_id.values() if len(x) > 1)[:2])
    for extra, p in ([], N.Params()), ([(f"x{k}", f"{base} b{k}") for k in range(20)], N.Params(hot=5)):
        given = rows + extra
        got = [(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, given), "id", "text", p).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(given, p) and tuple(k for k, _ in rows) in got
    assert [r["n_links"] for r in N.near_duplicate_groups(table(spark, rows), "id", "text").collect()] == [1, 1]


def test_keys_of_many_sets_of_several_blobs(spark):
    """A key that more than `hot` sets of several blobs share makes their pairs, one that more than `crowd` share is hot."""
    base = " ".join(f"t{j}" for j in range(20))
    sets = N.distinct_sets(table(spark, [(f"{k:04}", f"{base} a{k}") for k in range(60)]), "id", "text", N.Params())
    batches = sets.select("g", N._hashes("words").alias("hs")).toArrow().combine_chunks().to_batches(max_chunksize=5)
    ids = sorted(r["g"] for r in sets.collect())
    for crowd, pairs, hot in (1000, 60 * 59 // 2, 0), (20, None, 60):
        p = N.Params(hot=10, crowd=crowd)
        blobs = [x for b in N._band_blobs(16, p, 5)(iter(batches)) for x in b.to_pylist()]
        blobs = pa.RecordBatch.from_pylist(sorted(blobs, key=lambda x: x["bucket"]), pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("blob", pa.binary())]))
        met = {what: {(x["a"], x["b"]) for b in N._meetings(p, what)(iter([blobs])) for x in b.to_pylist()} for what in ("short", "hot")}
        assert {a for a, _ in met["hot"]} == set(ids if hot else [])
        assert pairs is None or met["short"] == {(a, b) for a in ids for b in ids if a < b} and len(met["short"]) == pairs


def test_long_sets(spark):
    """Pairs of sets of more than 32 and of more than 63 words, which registers are compared for, and of a long and a short one."""
    rows = [(f"{n:03}{k}", " ".join([*(f"w{n}x{j}" for j in range(n)), *(f"y{n}x{k}x{j}" for j in range(2 * k))])) for n in (30, 33, 50, 61, 90) for k in range(4)]
    p = N.Params()
    got = [(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(table(spark, rows), "id", "text", p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, p) and len(got) == 5 * 6
