"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest

from tableloom.llm import decontaminate, html, licenses, neardup, packing, quality, sharding, token_counts, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Text string, hits string, score string, n string, cls string, part string, ids string, shard string, toxic string, _q string"
LONG = "word" * 100_000 + " the end of it. " * 50_000
TEXTS = [None, "", " \n\t ", "one", "Plain words in one short line that nobody would mind to read at all.", LONG, "naïve café ☕ " * 40]


def messy(spark, rows=None):
    """Documents with a null id, repeated rows, and columns that clash with what operators use inside."""
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "no id"), (None, None)] if rows is None else rows
    return spark.createDataFrame([(k, t, "en", None if k == 1 else "web", 0, "X", *"abcdefgh", "q") for k, t in rows], DOCS)


ENCODERS = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}


def items(spark, *texts):
    return spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, text string")


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def tokens(spark, docs, tmp_path):
    token_files.write_tokens(docs, str(tmp_path / "tokens"), tokenizer=ENCODERS["word"])
    return token_files.with_crc(token_files.read_tokens(spark, str(tmp_path / "tokens")))


OPERATORS = {
    "neardup": lambda spark, d, tmp: neardup.near_copies(d),
    "quality": lambda spark, d, tmp: quality.quality(d),
    "licenses": lambda spark, d, tmp: licenses.scan(d),
    "token_files": tokens,
    "toxicity": lambda spark, d, tmp: toxicity.score(d, toxicity.fit(d, labels(spark, (3, None, 1), (None, 1, 1), (4, 1, None), (5, 1, 0)))),
    "token_counts": lambda spark, d, tmp: token_counts.token_counts(d, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "decontaminate": lambda spark, d, tmp: decontaminate.contaminated(d, items(spark, None, "", "one", "nobody would mind to read at all and more of it")),
    "sharding": lambda spark, d, tmp: sharding.shard(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_messy_rows_each_give_a_row(spark, name, tmp_path):
    docs = messy(spark)
    got = OPERATORS[name](spark, docs, tmp_path).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name, tmp_path):
    assert OPERATORS[name](spark, messy(spark, []), tmp_path).collect() == []


def test_packing_of_messy_rows(spark):
    got = packing.pack(messy(spark), tokenizer=ENCODERS["byte"]).collect()
    assert sum(r.length for r in got if r.doc_id == 3) == 3 * next(r.doc_tokens for r in got if r.doc_id == 3)
    assert all(r.doc_tokens == 1 for r in got if r.doc_id in (0, 1))
    assert packing.pack(messy(spark, []), tokenizer=ENCODERS["byte"]).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>" + "text " * 200_000, "x"), (4, "u", "<![bad[ <p>one &amp; two</p>", "x"), (4, "u", "<![bad[ <p>one &amp; two</p>", "x")],
        "page_id long, url string, html string, HTML string",
    )
    got = sorted(html.extract(pages).collect(), key=lambda r: (r.page_id or 0, r.n_chars))
    assert [r.n_chars for r in got if r.page_id in (1, 2)] == [0, 0]
    assert got[0].n_chars == 999_999
    assert got[3].text == got[4].text and "one & two" in got[3].text
    assert html.extract(pages.where("false")).collect() == []


def test_null_text_and_rows_without_id(spark):
    near = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_copies(messy(spark)).collect()}
    assert {(0, 0, 0, True), (1, 0, 1, True), (3, 1, 3, True)} <= near
    assert all(not kept for doc_id, _, _, kept in near if doc_id is None)
    judged = {r.doc_id: r for r in quality.quality(messy(spark)).collect()}
    assert all(judged[k].base_failed and not judged[k].kept for k in (0, 1, 2, 3))
    assert judged[4].kept


def test_no_labels_at_all(spark):
    docs = messy(spark)
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels(spark))).collect()} == {toxicity.score(docs, toxicity.Model(toxicity.Lexicon({}), (0.0,) * 6, -30.0)).first().score}


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_pipeline_stages(spark, name, stage, tmp_path):
    """Messy and empty documents pass each stage; all but the last keep the columns of documents."""
    items(spark, "a b c d e f g h i j k").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark, (3, 1, 1), (4, 1, 0)).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (messy(spark), messy(spark, [])):
        got = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = got.collect()
        ids = {r.doc_id for r in docs.collect()}
        assert {r.doc_id for r in rows} <= ids
        if name in ("toxicity", "decontamination"):
            assert len(rows) == docs.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_one_name(spark, name, tmp_path):
    """Of two columns called text the first is taken, by every operator."""
    rows = [(3, "one", "other words", "web"), (4, "Plain words in one short line that nobody would mind to read at all.", None, "web"), (5, None, "one", None)]
    once = spark.createDataFrame(rows, "doc_id long, text string, other string, source string")
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    got, want = (OPERATORS[name](spark, d, tmp_path / at).collect() for d, at in ((once.toDF("doc_id", "text", "text", "source"), "a"), (once, "b")))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_clashing_names_of_one_spelling(spark):
    """Of several columns of one name the first is taken."""
    twice = spark.createDataFrame([(3, "one", "some other text")], "doc_id long, text string, other string").toDF("doc_id", "text", "text")
    assert {r.n_words for r in quality.quality(twice).where("doc_id = 3").collect()} == {1}
