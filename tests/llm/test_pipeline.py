"""Each stage of the pipeline against a plain version, on what the stage before kept."""

from __future__ import annotations

import re

import corpus_pipeline
import public_tokenizers
import pytest
from brute import WORD, check_pieces, components, encode

from tableloom.llm import quality

SF = "/root/testdata/sf0.001"
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows that go into the first stage and come out of each."""
    at, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
        out.append(docs.collect())
    return out


def fails(line: str) -> bool:
    n = len(WORD.findall(line))
    return n > 0 and bool(
        len(re.findall(r"[#*$%&|<>]+", line)) >= 0.3 * n
        or len(re.findall(r"[!?]{2,}", line)) >= 0.5 * n
        or re.search(quality.NAVIGATION, line.lower())
        or re.search(quality.BOILERPLATE, line.lower())
    )


def clean(text: str | None) -> str | None:
    """The text without failing lines, or None if the document is rejected."""
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    lines = (text or "").split("\n")
    lost = sum(len(WORD.findall(x)) for x in lines if fails(x))
    if len(words) < 10 or 100 * len(repeated) > 20 * len(words) or 100 * lost > 60 * len(words):
        return None
    return "\n".join(x for x in lines if not fails(x))


def test_quality(steps):
    short = [r for r in steps[0] if len(r.text or "") < 20_000]
    want = {r.doc_id: t for r in short if (t := clean(r.text)) is not None}
    ids = {r.doc_id for r in short}
    assert {r.doc_id: r.text for r in steps[1] if r.doc_id in ids} == want
    assert all(r.n_chars == len(r.text) for r in steps[1])


def test_toxicity_keeps_clean_documents(spark):
    """On enough labels to learn from (some of which are wrong): most toxic documents go, next to no clean one."""
    sf = "/root/testdata/sf0.01"
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    kept = {r.doc_id for r in corpus_pipeline.low_toxicity(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi").collect()
    toxic, clean_ones = ({r.doc_id for r in labels if r.toxic == k} for k in (1, 0))
    assert len(toxic - kept) >= 0.6 * len(toxic)
    assert len(clean_ones - kept) <= 0.02 * len(clean_ones)


def test_one_of_near_copies(steps):
    component = components({r.doc_id: r.text for r in steps[2]}, 5, 80)
    assert {r.doc_id for r in steps[3]} == set(component.values())


def test_decontamination(spark, steps):
    def words(text):
        return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    kept = set()
    for r in steps[3]:
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            kept.add(r.doc_id)
    assert {r.doc_id for r in steps[4]} == kept


def test_packing(steps):
    ids = encode(public_tokenizers.path("byte_bpe_50k.json"), [r.text for r in steps[4]], 0)
    assert check_pieces(steps[5], dict(zip((r.doc_id for r in steps[4]), ids, strict=True)), 1024) == 0


def test_run_is_the_stages_one_after_another(spark, steps):
    """Packing order follows partitions, so whole documents are compared."""
    got = corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()
    assert sorted(map(tuple, got)) == sorted({(r.doc_id, r.doc_tokens) for r in steps[5]})


def test_one_row_of_each_document_stays(spark):
    text = "a text of some words that is long enough to have shingles of its own and to be linked"
    rows = [(3, text), (3, text), (3, text + " with an end"), (5, text), (7, "another text altogether, which nothing else resembles"), (None, text), (None, text), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(3, text), (7, rows[4][1]), (None, text), (None, None)], key=str)
