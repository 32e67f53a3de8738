"""The automaton against distances, contexts, and held-out accuracy."""

from __future__ import annotations

import random
import string

import pytest
from brute import distance, swap_distance
from pyspark.sql import functions as F

from tableloom.llm import queries, toxicity
from tableloom.llm.toxicity import Automaton, Lexicon, Scorer


def test_automaton_finds_what_distances_find():
    rng = random.Random(4)
    terms = ["idiot", "moron", "stupid", "scumbag", "worthless", "vile"]
    automaton = Automaton(Lexicon(dict.fromkeys(terms, 1.0)))
    words = [*terms]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randrange(2)] = rng.choices(string.ascii_lowercase, k=rng.randrange(2))
        words.append("".join(w) or "x")
    for w in words:
        near = {t: distance(w, t) for t in terms if w == t or len(t) >= 5 and w[0] == t[0] and distance(w, t) <= 1}
        met = automaton.match(w)
        if not near:
            assert met is None, w
        else:
            assert met and met[1] == min(near.values()) and near[met[0]] == met[1], w


def test_quoted_terms_do_not_count_as_abuse():
    scorer = Scorer(Lexicon({"scumbag": 4.0, "worthless": 4.0}))
    abuse = scorer.features("you are a worthless scumbag and everybody knows it")
    quoted = scorer.features('the paper said "scumbag" is a rude word and called it a term of abuse')
    assert abuse[0] == 2 and abuse[3] == 2
    assert quoted[0] == 0 and quoted[2] == 1
    assert scorer.features(None) == scorer.features("") == [0.0] * toxicity.FEATURES


def test_stems_and_errors():
    scorer = Scorer(Lexicon({"scumbag": 4.0}, {"idio": 2.0}, frozenset({"scumbay"})))
    assert scorer.find("idiotic") == ("idio", 0)
    assert scorer.find("scumbg") == ("scumbag", 1)
    assert scorer.find("scumbay") is None
    assert scorer.find("bag") is None


def test_errors_in_the_first_letter_and_inside_stems(spark):
    rng = random.Random(7)
    terms = ["idiot", "moron", "stupid", "scumbag", "worthless", "vile"]
    automaton = Automaton(Lexicon(dict.fromkeys(terms, 1.0), first_letter=True))
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.choice([0, rng.randrange(len(w) + 1)])
            w[k : k + rng.randrange(2)] = rng.choices(string.ascii_lowercase, k=rng.randrange(2))
        w = "".join(w) or "x"
        near = {t: d for t in terms if (d := distance(w, t)) == 0 or d == 1 and len(t) >= 5}
        met = automaton.match(w)
        assert (met and met[1]) == (min(near.values()) if near else None), w
        assert not met or near[met[0]] == met[1], w
    rows = [("stupid", False, 20, 0), ("stupidity", False, 20, 0), ("stup", True, 40, 0), ("moron", False, 20, 0)]
    scorer = Scorer(toxicity._lexicon(spark.createDataFrame(rows, "word string, stem boolean, toxic bigint, clean bigint"), 200, 200, 100))
    assert scorer.find("stupids") == ("stup", 0)
    assert scorer.find("stpuid") is None and scorer.find("stpid") == scorer.find("tupidity") == ("stup", 1)
    assert scorer.find("xmoron") == scorer.find("noron") == scorer.find("oron") == ("moron", 1)


def test_counts_do_not_depend_on_partitions(spark):
    rows = [(f"word{k % 3} other{k}", 0) for k in range(30)] + [("word0 vile", 1)]
    sample = spark.createDataFrame(rows, "text string, toxic int")
    counted = [sorted(map(tuple, toxicity._counts(s, range(4, 6)).collect())) for s in (sample.coalesce(1), sample.repartition(31))]
    assert counted[0] == counted[1]
    assert ("word1", False, 0, 10) in counted[1] and ("other7", False, 0, 1) in counted[1]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, sf):
    """Rows whose labels were never seen: most toxic ones are caught and next to no clean one."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    scored = queries.op6_toxicity(spark, sf).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    caught, missed, wrong, right = (n.get(k, 0) for k in ((1, 1), (1, 0), (0, 1), (0, 0)))
    assert caught + missed > 20
    assert caught >= 0.8 * (caught + missed), n
    assert wrong <= 0.02 * (wrong + right), n


def test_scores_do_not_see_labels_source_or_id(spark):
    """Scores follow from texts alone; labels of held-out rows change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs.withColumn("source", F.lit("x")), flipped)


def test_two_errors_swaps_and_short_terms():
    """Terms of eight letters admit two errors, of five one, of four one wrong letter that is not the first."""
    rng = random.Random(11)
    terms = ["idiot", "moron", "stupid", "worthless", "disgusting", "scum", "vile"]
    lexicon = Lexicon(dict.fromkeys(terms, 1.0), first_letter=True, **toxicity.ERRORS)
    automaton = Automaton(lexicon)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.3 and 0 < k < len(w):
                w[k - 1], w[k] = w[k], w[k - 1]
            else:
                w[k : k + rng.randrange(2)] = rng.choices(string.ascii_lowercase, k=rng.randrange(2))
        w = "".join(w) or "x"
        near = {}
        for t in terms:
            d = swap_distance(w, t)
            if d == 0 or d <= lexicon.errors(t) and (len(t) >= 5 or len(w) == len(t) and w[0] == t[0]):
                near[t] = d
        met = automaton.match(w)
        assert (met and met[1]) == (min(near.values()) if near else None), w
        assert not met or near[met[0]] == met[1], w
    found = {w: automaton.match(w)[0] for w in ("idoit", "worhtless", "diot", "xdiot", "scvm", "wrothles")}
    assert found == {"idoit": "idiot", "worhtless": "worthless", "diot": "idiot", "xdiot": "idiot", "scvm": "scum", "wrothles": "worthless"}


def test_models_do_not_depend_on_partitions_or_repeated_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [toxicity.fit(docs.repartition(k), labels.repartition(k)) for k in (1, 4, 16)]
    assert models[0] == models[1] == models[2]
    assert toxicity.fit(docs.union(docs).union(docs), labels) == models[0]


def test_equal_texts_get_equal_scores_and_repeated_ids_a_row_each(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (1, "a calm day"), (2, "you idiot"), (2, "you idiot"), (3, None)], "doc_id long, text string")
    model = toxicity.Model(Lexicon({"idiot": 4.0}), (1.0,) * toxicity.FEATURES, -1.0)
    scores = [(r.doc_id, r.score) for r in toxicity.score(docs, model).orderBy("doc_id", "score").collect()]
    assert [k for k, _ in scores] == [1, 1, 2, 2, 3]
    assert scores[1][1] == scores[2][1] == scores[3][1] > scores[0][1] == scores[4][1]


def test_few_words_of_a_sample_pass_by_chance(spark):
    """Words that stand in a few toxic documents and in no clean one are no terms where the sample has many words."""
    insult = spark.createDataFrame([("insult", False, 30, 0)], "word string, stem boolean, toxic bigint, clean bigint")
    counts = insult.union(spark.range(50_000).select(F.concat(F.lit("w"), "id"), F.lit(False), F.lit(3), F.lit(0)))
    assert set(toxicity._lexicon(counts, 60, 500, 4000).terms) == {"insult"}
