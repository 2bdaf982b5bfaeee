import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.llm import bpe as B
from burstline.llm import packing as K

if not os.path.exists(f"{B.FOLDER}/byte_bpe_50k.json"):
    pytest.skip("no vocabulary here", allow_module_level=True)

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    path = f"{B.FOLDER}/byte_bpe_50k.json"
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    with open(path, "rb") as f:
        return B.Bpe(f.read()), other


def same(both, text):
    ids = np.frombuffer(both[0].encode(text), np.int32)
    assert ids.tolist() == both[1].encode(text, add_special_tokens=False).ids
    assert both[0].decode(ids).decode() == text


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abest ing'sTHE  \n\r\t0129.,!-é中Ω  \x1c​😀")), max_size=80))
def test_equals_the_merges(both, text):
    same(both, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x2FFF), max_size=40))
def test_equals_the_merges_on_any_script(both, text):
    same(both, text)


@pytest.mark.parametrize("text", ["", " ", "   ", "a  b ", "\n\n x", "<|endoftext|>", "a" * 3000, "ab" * 2000, " " * 500 + "x", "don't we'll I'D", "x" * 47 + " " + "y" * 200])
def test_edges(both, text):
    same(both, text)
    same(both, text)


def test_table(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "ab " * 30_000)]
    df = spark.createDataFrame([(k, t, [1]) for k, t in rows], "doc_id long, text string, ids array<int>")
    out = B.encode_table(df, "doc_id", "text")
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 2
    assert {(r["doc_id"], r["text"]) for r in B.decode_table(out, "doc_id", "ids").collect()} == {(k, t or "") for k, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in B.token_lengths(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert B.encode_table(df.limit(0), "doc_id", "text").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120))
def test_packing_places_all_once(sizes):
    out = K.pack([(s, k) for k, s in enumerate(sizes)], [8, 16, 64])
    assert sorted(i for _, inside in out for _, i in inside) == [k for k, s in enumerate(sizes) if s]
    assert all(sum(s for s, _ in inside) <= capacity for capacity, inside in out)
    assert all(s > (0 if capacity == 8 else capacity // 4 if capacity == 64 else 8) for capacity, inside in out for s, _ in inside[:1])


def test_packing_fills_and_splits(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(x)) for k, x in enumerate(rng.integers(1, 900, 4000))] + [(9000, 100_000), (9001, 0), (9002, None), (9003, -4), (None, 5), (3, 1)]
    df = spark.createDataFrame([(k, n, "clash") for k, n in rows], "doc_id long, n_tokens long, grp string")
    got = K.pack_table(df, "doc_id", "n_tokens", [[512], [512, 2048]], len(rows), group_items=1000).toPandas()
    sizes = {k: n for k, n in rows if k is not None and n and n > 0} | {3: max(rows[3][1], 1)}
    for plan, top in (("0", 512), ("1", 2048)):
        part = got[got["container"].str.startswith(plan + "-")]
        assert part.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
        used = part.groupby("container")["n_tokens"].sum()
        capacity = part.groupby("container")["capacity"].first()
        assert (used <= capacity).all() and used.sum() / capacity.sum() > 0.98
        split = part[part.groupby("doc_id")["piece"].transform("max") > 0]["doc_id"].unique()
        assert all(sizes[k] > top for k in split)
        pieces = part[part["doc_id"] == 9000].sort_values("piece")
        assert (pieces["start"].to_numpy() == np.append(0, np.cumsum(pieces["n_tokens"]))[:-1]).all()
    steps = got[got["container"].str.startswith("1-")].groupby(["capacity", "step"])["n_tokens"].sum()
    assert len(steps) > 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120))
def test_tiers_of_one_capacity(sizes):
    out = K.pack([(s, k) for k, s in enumerate(sizes)], [8, 16, 32, 64], 64)
    assert sorted(i for _, inside in out for _, i in inside) == [k for k, s in enumerate(sizes) if s]
    assert all(capacity == 64 and sum(s for s, _ in inside) <= 64 for capacity, inside in out)
    opened = [next(t for t in (8, 16, 32, 64) if inside[0][0] <= t) for _, inside in out]
    assert opened == sorted(opened, reverse=True)  # the long tiers open containers first
    rest = sorted(s for s in sizes if s)
    for _, inside in out:
        gap = 64
        for size, _ in inside:  # each gap takes the largest item that is left and fits
            assert size == max(s for s in rest if s <= gap)
            rest.remove(size)
            gap -= size
        assert not any(s <= gap for s in rest)


def test_steps_of_even_load(spark):
    rng = np.random.default_rng(2)
    rows = [(k, int(x)) for k, x in enumerate(rng.integers(1, 400, 6000))]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = K.pack_table(df, "doc_id", "n_tokens", [[64, 128, 256, 512]], len(rows), per_step=32, group_items=2000, fixed=True).toPandas()
    assert set(got["capacity"]) == {512} and got["n_tokens"].sum() == sum(n for _, n in rows)
    per_step = got.groupby("step")["container"].nunique()
    load = got.groupby("step")["n_tokens"].sum() / per_step
    assert per_step.max() <= 32 and load.min() > 0.9 * load.max()  # over all groups
