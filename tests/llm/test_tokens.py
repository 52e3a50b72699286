"""Encoding and packing."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import bpe, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
VOCABULARY = bpe.read_vocabulary(bpe.default_path())
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(VOCABULARY), special_tokens={})
ENCODE, DECODE = bpe.encoder(VOCABULARY), bpe.decoder(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert ENCODE(text) == REFERENCE.encode_ordinary(text)
    assert DECODE(ENCODE(text)) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "don't we'll I'M", " \r\n\t  x", "魚の品質検査", "👨‍🔬", "a" * 50_000, "ab" * 30_000, " " * 5000, "1e-07 0x7fffffff"])
def test_hard_texts(text):
    assert ENCODE(text) == REFERENCE.encode_ordinary(text) and DECODE(ENCODE(text)) == text


def test_table(spark):
    rows = spark.createDataFrame([(1, "Belly opening", 5), (2, "", 5), (3, None, 5), (3, None, 5), (None, "x", 5)], "doc_id bigint, text string, ids int")
    got = bpe.encode_column(rows, "doc_id").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter({(1, tuple(REFERENCE.encode_ordinary("Belly opening"))): 1, (2, ()): 1, (3, ()): 2, (None, tuple(REFERENCE.encode_ordinary("x"))): 1})
    back = bpe.decode_column(bpe.encode_column(rows, "doc_id"), "doc_id").where("doc_id = 1").first()
    assert back.text == "Belly opening" and DECODE([10**9]) == "" and DECODE(None) is None
    assert bpe.encode_column(rows.limit(0), "doc_id").count() == 0


def test_another_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = spark.createDataFrame([(1, "Räuchergasse 93B")], "doc_id bigint, text string")
    want = tiktoken.Encoding("m", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe.read_vocabulary(path)), special_tokens={}).encode_ordinary("Räuchergasse 93B")
    assert bpe.encode_column(rows, "doc_id", path=path).first().ids == want


def fewest(sizes, capacity):
    """The least number of containers, by search."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i]:
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_best_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    least = fewest(sizes, 20)
    bins = packing.best_fit(np.array(sizes), 20)
    fill = np.bincount(bins, weights=sizes)
    assert packing.bound(np.array(sizes), 20) <= least <= len(fill) and fill.max() <= 20


def pack(spark, texts, capacities):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as n_tokens", "2 as bin", "'x' as budget_id")
    budgets = spark.createDataFrame([(i, "p", c) for i, c in enumerate(capacities)], "budget_id int, purpose string, capacity_tokens int")
    rows = packing.containers(docs, budgets).collect()
    fills, pieces = defaultdict(int), defaultdict(list)
    for r in rows:
        fills[r.budget_id, r.container] += r.n_tokens
        pieces[r.budget_id, r.doc_id].append(r)
    assert all(fills[r.budget_id, r.container] == r.fill_tokens <= r.capacity_tokens for r in rows)
    return rows, fills, pieces


def test_containers(spark):
    texts = ["fish " * n for n in (1, 5, 30, 31, 64, 100)] + ["", None, ""]
    rows, fills, pieces = pack(spark, texts, [32, 64, None, 0, -5])
    assert {b for b, _ in pieces} == {0, 1} and len(pieces) == 2 * len(texts)
    for (b, doc), p in pieces.items():
        n = len(REFERENCE.encode_ordinary(texts[doc] or ""))
        c = p[0].capacity_tokens
        assert sum(r.n_tokens for r in p) == n and len(p) == max(1, -(-n // c)) and sorted(r.piece for r in p) == list(range(len(p)))


def test_exchange_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART_ITEMS", 15)
    rng = np.random.default_rng(2)
    texts = [" fish" * int(n) for n in rng.integers(20, 60, 150)]
    rows, fills, _ = pack(spark, texts, [100])
    sizes = np.array([r.n_tokens for r in rows])
    assert len(fills) <= packing.bound(sizes, 100) * 1.1 + 1 and {r.container.split("-")[0] for r in rows} > {"r0", "r1"}
    assert Counter(r.doc_id for r in rows) == Counter(range(150))


def test_empty_tables(spark):
    assert pack(spark, [], [32])[0] == [] and pack(spark, ["a"], [])[0] == []


def test_all_orders_of_small_sizes():
    for sizes in itertools.product((3, 5, 7), repeat=4):
        bins = packing.best_fit(np.array(sizes), 10)
        assert np.bincount(bins, weights=sizes).max() <= 10


def test_repeated_identifiers_and_summary(spark):
    """Two long rows under one doc_id fill containers of their own; the bound holds for every budget."""
    text = "fish " * 300
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short"), (None, "no id"), (3, None)], "doc_id bigint, text string")
    budgets = spark.createDataFrame([(1, 100), (2, 1000), (3, 0)], "budget_id int, capacity_tokens int")
    rows = packing.containers(docs, budgets).collect()
    fills = {}
    for r in rows:
        fills.setdefault((r.budget_id, r.container), []).append(r)
    for (budget, _), of in fills.items():
        assert sum(r.n_tokens for r in of) == of[0].fill_tokens <= of[0].capacity_tokens
    for r in packing.summary(docs, budgets).collect():
        mine = [r_ for r_ in rows if r_.budget_id == r.budget_id]
        assert r.tokens == sum(x.n_tokens for x in mine) and r.containers == len({x.container for x in mine})
        assert r.bound <= r.containers and r.certified_parts <= r.last_parts and r.rounds == 1
