"""Windows of benchmark items in documents, found both ways, against comparing all places."""

from __future__ import annotations

import random
import re

import pytest

from tableloom.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text: str | None, items: list[tuple[str | None, str | None]], size: int) -> tuple[int, list[int], list[str]]:
    w, hits, met = words(text), set(), set()
    for name, item in items:
        own = words(item)
        for i in range(max(1, len(own) - size + 1) if own and name else 0):
            window = own[i : i + size]
            for k in range(len(w) - len(window) + 1):
                if w[k : k + len(window)] == window:
                    hits.update(range(k, k + len(window)))
                    met.add(name)
    return len(w), sorted(hits), sorted(met)


def cases(seed: int):
    rng = random.Random(seed)
    said = [f"w{k}" for k in range(30)] + ["Éa", "日本", "7up"]
    items = [(f"i{k}", " ".join(rng.choices(said, k=rng.randrange(1, 25)))) for k in range(40)]
    items += [(f"same{k}", items[0][1] + " and the same passage of ten words or a few more") for k in range(15)]
    items += [(None, "w1 w2 w3"), ("empty", ""), ("null", None), ("one", "Solitary"), ("two", "w1 -- w2"), ("i0", items[0][1])]
    texts = []
    for _ in range(60):
        parts = [" ".join(rng.choices(said, k=rng.randrange(12))), rng.choice(items)[1] or "", rng.choice(["solitary.", "SOLITARY", "", "w1, w2"])]
        cut = words(parts[1])
        parts[1] = " ".join(cut[rng.randrange(3) :])
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    return [*texts, None, "", *[texts[0]] * 30], items


@pytest.mark.parametrize(("most", "bits"), [(200_000, 26), (0, 20), (0, 7)])
def test_all_places(spark, most, bits):
    texts, items = cases(most + bits)
    docs = spark.createDataFrame([(k % 50 if k % 7 else None, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contaminated(docs, bench, window=6, most=most, filter_bits=bits, keep=("source",)).collect()
    assert len(got) == len(texts)
    want = {t: brute(t, items, 6) for t in set(texts)}
    for r in got:
        assert r.text == texts[int(r.source[1:])]
        assert (r.n_words, list(r.hits), list(r["items"])) == want[r.text], r.text


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "w1 w2 w3")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "w1 w2")], "item_id string, text string")
    for most in (10, 0):
        assert [list(r.hits) for r in decontaminate.contaminated(docs, none, most=most).collect()] == [[]]
        assert [list(r.hits) for r in decontaminate.contaminated(docs, some, most=most).collect()] == [[0, 1]]
        assert decontaminate.contaminated(docs.where("false"), some, most=most).collect() == []
