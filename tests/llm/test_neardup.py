"""Near copies against comparing all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import components, shingles

from tableloom.llm import neardup


def copies(seed: int, n: int = 60) -> dict[int, str | None]:
    """Texts of 30 to 120 words with copies that differ in a few words."""
    rng = random.Random(seed)
    texts: dict[int, str | None] = {}
    for k in range(n):
        if texts and rng.random() < 0.6:
            words = (texts[rng.choice(list(texts))] or "x").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(50)}"
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(30, 120))]
        texts[10 * k + 3] = " ".join(words)
    return texts | {1: None, 2: "", 4: " \t\n", 5: "two words", 6: "Two\x0bWORDS", 7: "ten", 8: "TEN"}


@pytest.mark.parametrize(("width", "percent", "block"), [(3, 85, 1024), (5, 80, 1024), (3, 85, 8)])
def test_all_pairs(spark, width, percent, block):
    texts = copies(width * percent + block)
    got = neardup.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=width, percent=percent, block=block).collect()
    want = components(texts, width, percent)
    assert len(got) == len(texts)
    for r in got:
        assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(shingles(texts[r.doc_id], width)), want[r.doc_id] == r.doc_id)


def test_documents_of_the_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = components({r.doc_id: r.text for r in docs.collect()}, 5, 80)
    assert {r.doc_id: r.component_id for r in neardup.near_copies(docs, shingle=5, percent=80).collect()} == want


def test_chains_and_a_large_group(spark):
    """A chain of single changes links its ends; thousands of copies are one group."""
    words = [f"c{i}" for i in range(200)]
    texts = {}
    for k in range(12):
        texts[100 + k] = " ".join(words)
        words[17 * k] = f"other{k}"
    texts |= {1000 + k: "the same long text for all of them " * 4 for k in range(3000)}
    got = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {got[k] for k in range(100, 112)} == {100}
    assert {got[1000 + k] for k in range(3000)} == {1000}


def test_signature_distance_is_found_by_pigeonhole():
    """Any two signatures within the allowed errors share a key."""
    import numpy as np

    rng = np.random.default_rng(3)
    for plan in (neardup.Plan(), neardup.Plan(5, 80)):
        for _ in range(200):
            x = rng.integers(0, 1 << 16, plan.symbols, dtype="<u2")
            y = x.copy()
            at = rng.choice(plan.symbols, plan.errors, replace=False)
            y[at] ^= 1
            keys = neardup.keys_of(np.stack([x, y]), plan)
            assert (keys[0] == keys[1]).any()


def test_texts_of_one_doc_id_are_one_document(spark):
    """Different texts of a doc_id are linked, whichever of them other documents resemble."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(4, a), (4, b), (4, a), (9, b + " more"), (2, a + " more"), (6, "nothing like them at all"), (7, b), (None, b)]
    got = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(4, 2, False)] * 3 + [(9, 2, False), (2, 2, True), (6, 6, True), (7, 2, False), (None, 2, False)], key=str)


@pytest.mark.parametrize("block", [16, 64])
def test_groups_larger_than_a_block(spark, block):
    """Hundreds of different near copies share keys that fill many blocks, beside others close to the threshold."""
    rng = random.Random(block)
    words = [f"w{i}" for i in range(150)]
    texts = {}
    for k in range(500):
        own = list(words)
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            own[rng.randrange(150)] = f"x{rng.randrange(10_000)}"
        texts[k] = " ".join(own)
    got = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect()}
    assert got == components(texts, 3, 85)


def _made(spark, node: str, since: int) -> int:
    """Rows that the plan nodes of this description made in executions from `since` on."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for execution in range(since, store.executionsCount()):
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for x in (nodes.apply(k) for k in range(nodes.size())):
            metrics = x.metrics()
            if node in x.desc():
                made = [m.accumulatorId() for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows"]
                rows += sum(int(values.apply(m).replace(",", "")) for m in made if values.contains(m))
    return rows


def test_a_large_group_computes_no_keys_of_others_again(spark):
    """Beside keys of many blocks, rows are keyed once for the counts, once to meet and once for the large keys."""
    rng = random.Random(1)
    texts = {k: " ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for k in range(100, 500)}
    for k in range(60):
        own = [f"g{i}" for i in range(150)]
        for i in rng.sample(range(150), rng.choice([1, 1, 2, 8])):
            own[i] = f"x{k}"
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.doc_id: r.component_id for r in neardup.near_copies(docs, block=16).collect()}
    assert got == components(texts, 3, 85)
    made = _made(spark, "keyed(", since) / 64 / len(texts)
    assert 2 < made < 3.9, made


def test_spread_join_is_a_join(spark):
    from pyspark.sql import functions as F

    from tableloom.llm.shared import spread_join

    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = spark.range(0, 5000, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = many.groupBy("k").agg(F.count("*").alias("_n"))
    for how in ("inner", "left"):
        got = spread_join(many, one, "k", "v", counts, how).select("k", "v", "w").collect()
        assert sorted(map(str, got)) == sorted(map(str, many.join(one, "k", how).select("k", "v", "w").collect()))


def test_components_by_broadcast_and_by_shuffle(spark):
    edges = spark.createDataFrame([(k, k + 7) for k in range(0, 600, 3)] + [(900, k) for k in range(901, 990)] + [(5, 5)], "a bigint, b bigint")
    few, many = ({(r.node, r.label) for r in neardup.components(edges, most).collect()} for most in (500_000, 0))
    assert few == many
    assert {label for node, label in few if node >= 900} == {900}


def test_small_groups_are_compared_together():
    """Many keys with two members each cost few calls; groups stay whole over batches."""
    rows = pa.table({"key": [1, 1, 2, 3, 3, 3, 4, 4], "side": pa.array([0, 0, 0, 0, 0, 1, 0, 0], pa.int32())})
    groups = [(t.column("key").to_pylist(), begins.tolist()) for t, begins in neardup._groups(iter(rows.to_batches(max_chunksize=3)), ["key", "side"])]
    found = [keys[a:b] for keys, begins in groups for a, b in zip(begins, [*begins[1:], len(keys)], strict=True)]
    assert found == [[1, 1], [2], [3, 3], [3], [4, 4]]
    apart, begins = pa.table({"key": [0] * 2000}), np.arange(0, 2000, 2)
    assert [(a.tolist(), b.tolist()) for a, b in neardup._met(apart, begins, False)] == [(list(range(0, 2000, 2)), list(range(1, 2000, 2)))]
