"""Token files, counts and packing against encoding each text alone."""

from __future__ import annotations

import math
import random

import public_tokenizers
import pytest
from brute import check_pieces, crc, encode
from pyspark.sql import functions as F

from tableloom.llm import packing, queries, token_counts, token_files
from tableloom.llm.encode import encoder

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  two  spaces ", "a\n\n b\t c", " lead", "trail ", "it's we'll I'M", "x \x01 y \x01", "<|endoftext|> here", " 　wide no-break", "日本語 の テキスト", "a" * 5000, "1234 56,789.00", "\r\n \r\n", "é é", "​   x", "🙂 🙂🙂 ok", "\x85 \x1c z", "don't  stop\n\n\nnow"]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    import pyarrow as pa

    path, rng = public_tokenizers.path(name), random.Random(5)
    joined = ["".join(rng.choice(ODD) + rng.choice(["", " ", "\n", "  "]) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    texts = [None, *ODD, *joined, *(r.text for r in documents(spark).select("text").collect())]
    got = encoder(path).encode(pa.array(texts, pa.string()))
    want = encode(path, texts, 0)
    for text, a, b in zip(texts, got, want, strict=True):
        assert a == b"".join(i.to_bytes(4, "little") for i in b[:-1]), repr(text)[:200]


def test_token_files(spark):
    docs = documents(spark).orderBy("doc_id").collect()
    want, start = [], 0
    for d, ids in zip(docs, encode(public_tokenizers.path("word_bpe_49k.json"), [d.text for d in docs], 1), strict=True):
        want.append((d.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.op5_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_token_file_format(spark, tmp_path):
    """ORC with row indexes and Bloom filters on doc_id, in ascending order over the files; a filter on doc_id is pushed down."""
    path = str(tmp_path / "tokens")
    token_files.write_tokens(documents(spark), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration() if hasattr(spark, "_jsc") else spark.sparkContext._jsc.hadoopConfiguration()
    last = -1
    for file in sorted((tmp_path / "tokens").glob("*.orc")):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        if not reader.getNumberOfRows():
            continue
        assert reader.getRowIndexStride() > 0
        rows = reader.rows()
        kinds = {s.getKind().toString() for s in rows.readStripeFooter(reader.getStripes()[0]).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
        ids = [r.doc_id for r in spark.read.orc(str(file)).select("doc_id").collect()]
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    plan = token_files.read_tokens(spark, path).where("doc_id = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,7)" in plan


def test_token_counts(spark):
    """Unigram forward scores of each word alone, position by position."""
    scores = token_counts.unigrams(public_tokenizers.path("byte_bpe_50k.tiktoken"))

    def pieces(word: bytes) -> int:
        best = [(0.0, 0)] + [(math.inf, 0)] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = min((best[k][0] - scores[word[k:end]], best[k][1] + 1) for k in range(end) if word[k:end] in scores)
        return best[-1][1]

    texts = {r.doc_id: r.text for r in documents(spark).where("doc_id % 4 = 0").collect()} | {-1: "été 日本 🙂 unbelievableness", -2: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    known: dict[bytes, int] = {}
    for r in token_counts.token_counts(docs, vocabulary=public_tokenizers.path("byte_bpe_50k.tiktoken")).collect():
        words = [b" " + w for w in (texts[r.doc_id] or "").encode().split()]
        for w in words:
            if w not in known:
                known[w] = pieces(w)
        assert (r.n_bytes, r.n_words, r.n_tokens) == (len((texts[r.doc_id] or "").encode()), len(words), sum(known[w] for w in words))


def test_packing(spark):
    rows = queries.op8_packing(spark, SF).collect()
    docs = documents(spark).collect()
    ids = dict(zip((d.doc_id for d in docs), encode(public_tokenizers.path("byte_bpe_50k.json"), [d.text for d in docs], 0), strict=True))
    assert check_pieces(rows, ids, 1024) == 0


def test_packing_over_many_partitions(spark):
    docs = documents(spark).repartition(7, "doc_id")
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = dict(zip((d.doc_id for d in docs.collect()), encode(path, [d.text for d in docs.collect()], 0), strict=True))
    assert check_pieces(packing.pack(docs, tokenizer=path, size=256, window=16).collect(), ids, 256) == 0


def test_minimum_slack():
    """fill comes as close to the capacity as any multiset does."""
    from itertools import product

    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        capacity = rng.randrange(1, 90)
        used = packing.fill(counts, capacity)
        assert all(n <= counts[k] for k, n in used.items())
        sums = (sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in product(*(range(n + 1) for n in counts.values())))
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= capacity)


def test_reader_positions_do_not_depend_on_files(spark, tmp_path):
    docs = documents(spark).withColumn("text", F.substring("text", 1, 200))
    got = []
    for k, parts in enumerate(("3", "8")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        token_files.write_tokens(docs, str(tmp_path / str(k)), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
        got.append(sorted(map(tuple, token_files.read_tokens(spark, str(tmp_path / str(k))).drop("ids").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


def test_one_doc_id_spreads_over_files(spark, tmp_path):
    """A doc_id of half the rows is written by more than one task, and positions stay gapless."""
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_tokens(rows, path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.start, r.n_tokens) for r in token_files.read_tokens(spark, path).drop("ids").collect())
    assert len(got) == 4000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
    assert spark.read.orc(path).where("doc_id IS NULL").select("part").distinct().count() > 1


def test_packing_cuts_where_nothing_fills(spark):
    """Rests that never fill a window together are cut, however many come."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" the"), 599).alias("text")).coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = dict(enumerate(encode(path, [" the" * 599] * 3000, 0)))
    got = packing.pack(docs, tokenizer=path, window=500).collect()
    assert check_pieces(got, ids, 1024) == 0
    assert len({r.sequence_id for r in got}) <= 3000 * 600 // 1024 + 11


def test_pre_tokens_make_up_the_whole_text():
    for text in ODD:
        assert b"".join(token_counts.PRE_TOKENS.findall(text.encode())) == text.encode()
    assert token_counts.PRE_TOKENS.findall(b"one  two\n\nthree four ") == [b"one", b" ", b" two", b"\n\n", b"three", b" four", b" "]


def test_fitted_unigram_model(spark):
    """Shares of pieces on the best paths of all pre-tokens, and counts under them, against plain loops."""
    from collections import Counter

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    prior = token_counts.unigrams(path)

    def best(word: bytes, scores: dict[bytes, float]) -> tuple[bytes, ...]:
        ways: list = [(0.0, 0, 0)] + [None] * len(word)
        for end in range(1, len(word) + 1):
            ways[end] = min(((ways[k][0] - scores[word[k:end]], ways[k][1] + 1, k) for k in range(end) if word[k:end] in scores))
        out, d = [], len(word)
        while d:
            out.append(word[ways[d][2] : d])
            d = ways[d][2]
        return tuple(out)

    texts = {r.doc_id: r.text for r in documents(spark).where("doc_id % 5 = 0").collect()} | {-1: "two  spaces\n\nand more ", -2: None, -3: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    words = Counter(w for t in texts.values() for w in token_counts.PRE_TOKENS.findall((t or "").encode()))
    total = Counter()
    for w, n in words.items():
        for piece in best(w, prior):
            total[piece] += n
    scores = token_counts.fitted(docs, path)
    assert scores.keys() == prior.keys()
    assert all(math.isclose(scores[p], math.log((total[p] + 1) / (total.total() + len(prior)))) for p in prior)
    n = {w: len(best(w, scores)) for w in words}
    for r in token_counts.token_counts(docs, vocabulary=path, scores=scores, white_space=True).collect():
        text = (texts[r.doc_id] or "").encode()
        assert (r.n_bytes, r.n_words, r.n_tokens) == (len(text), len(text.split()), sum(n[w] for w in token_counts.PRE_TOKENS.findall(text)))


def test_words_of_letters_are_encoded_without_marks(monkeypatch):
    """Where the model ends words with a suffix; words that become several fall back to marks."""
    from tableloom.llm import encode

    class Seen:
        def __init__(self, inner):
            self.inner, self.texts = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            self.texts += texts
            return self.inner.encode_batch_fast(texts, **options)

    plain, odd = {f" Wort{chr(97 + a)}{chr(97 + b)}ß" for a in range(20) for b in range(20)}, {" \u0130stanbul", " x9", "Wort", " don't"}
    enc = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    enc.tokenizer = Seen(enc.tokenizer)
    enc.learn(plain)
    assert enc.tokenizer.texts and not any("\x01" in t for t in enc.tokenizer.texts)
    enc.learn(odd | {f"{p}a" for p in plain})
    for part, ids in enc.new.items():
        assert ids == encode.ids_bytes(enc.tokenizer.encode(part, add_special_tokens=False).ids), part
    assert enc.new.keys() >= plain | odd


def test_encoder_remembers_in_little_memory():
    """Tens of thousands of parts take no Python object each, few go to the library at once, and what is forgotten is encoded anew."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    from tableloom.llm.encode import Encoder, ids_bytes

    path, handed = public_tokenizers.path("byte_bpe_50k.json"), []

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **options):
            handed.append(sum(map(len, texts)))
            return self.inner.encode_batch_fast(texts, **options)

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=8)) for _ in range(500)) for _ in range(80)]
    enc = Encoder(path)
    enc.tokenizer = Counting(enc.tokenizer)
    enc.encode(pa.array(texts[:1]))
    tracemalloc.start()
    enc.encode(pa.array(texts))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 4_000_000 and max(handed) < 100_000
    want = [ids_bytes(ids[:-1]) for ids in encode(path, texts, 0)]
    small = Encoder(path, 1000)
    for _ in range(2):
        for k in range(0, 80, 8):
            assert small.encode(pa.array(texts[k : k + 8])) == want[k : k + 8]
            assert len(small.known) <= 1000
    long = ["x" * 50_000, "ab " * 9]
    assert small.encode(pa.array(long)) == [ids_bytes(ids[:-1]) for ids in encode(path, long, 0)]
    assert pc.sum(pc.binary_length(small.known)).as_py() <= 40 * 1000
