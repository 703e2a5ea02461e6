"""BPE, token counts and quality rules against libraries and brute force."""

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellcast.llm import bpe, quality, token_counts
from cellcast.llm.queries import vocabulary_path
from cellcast.llm.text import slices, utf8
from helpers import PROSE, docs, sentence

AWKWARD = [" ", "  ", "\n", " \n", "\t", "a", "aaa", "the", "'s", "'ll", "'", "'re", "1", "²", "½", "Ⅷ", "é", "中文",
           "<|endoftext|>", "<|endof", "\xa0", "\x85", "\x1c", "!", "?!", "🙂", "́", "\r\n", "\x00", "ª", "_", "　"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path())


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(AWKWARD) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None, PROSE * 300]


def test_encoder_equals_library(library):
    enc = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(vocabulary_path())))
    texts = strings(2000, 3)
    for text, ids in zip(texts, enc.encode_texts(texts), strict=True):
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        assert bpe.decode_bytes(enc.vocab, np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_merges_that_use_later_tokens_are_refused():
    spec = json.loads(bpe.read_vocabulary(vocabulary_path()))
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        bpe.Vocabulary(json.dumps(spec))


def test_round_trip_query_and_decode(spark, library):
    texts = [PROSE, None, "", "<|endoftext|> x", "ab" * 50_000, PROSE]
    d = docs(spark, texts, ["ids", "n_tokens"])
    got = {r.doc_id: r for r in bpe.round_trip_digests(d, vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(d, vocabulary_path()), vocabulary_path()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip_digests(d.limit(0), vocabulary_path()).count() == 0


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 0, 50, 3, 3, 3)] + [None])], ["text"])
    parts = list(slices(iter([batch]), "text", 8))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert [p.num_rows for p in parts] == [2, 1, 2, 2]
    assert utf8(batch.column(0))[1].tolist() == [0, 5, 5, 55, 58, 61, 64, 64]


def test_token_counts_use_the_cache(spark, library, tmp_path):
    texts = [PROSE, PROSE, None, "", "<|endoftext|>a", PROSE * 200]
    d, cache = docs(spark, texts, ["digest", "n_tokens"]), str(tmp_path / "cache")
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    rows = token_counts.count_tokens(d, vocabulary_path(), cache).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
    assert {r.doc_id: r.n_bytes for r in rows} == {i: len((t or "").encode()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.over_limit for r in rows} == {i: n > 512 for i, n in want.items()}
    assert spark.read.parquet(cache).count() == 4  # distinct texts
    token_counts.count_tokens(docs(spark, [*texts, "new"]), vocabulary_path(), cache).collect()
    assert spark.read.parquet(cache).count() == 5  # one more, the rest was stored
    assert token_counts.count_tokens(d.limit(0), vocabulary_path(), cache).count() == 0
    # A cache that holds every digest twice, as two runs at once would leave it, and one of another tokenizer.
    spark.read.parquet(cache).coalesce(1).write.parquet(str(tmp_path / "again"))
    again = spark.read.parquet(str(tmp_path / "again"))
    again.unionAll(again.selectExpr("'other' AS tokenizer", "digest", "n_tokens + 1 AS n_tokens")).write.mode("append").parquet(cache)
    rows = token_counts.count_tokens(d, vocabulary_path(), cache).collect()
    assert len(rows) == len(texts) and {r.doc_id: r.n_tokens for r in rows} == want
    assert spark.read.parquet(cache).count() == 15  # nothing was encoded again


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(name):
    texts = ["The Mill.", "", PROSE, "déjà vu 中文"]
    source = token_counts.read_tokenizer(vocabulary_path(name))
    got = token_counts.counter(name, name, source).counts(*utf8(pa.array(texts))).tolist()
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=source)
        assert got == [len(sp.encode(t)) for t in texts]
    else:
        from tokenizers import Tokenizer
        tk = Tokenizer.from_str(source.decode())
        assert got == [len(tk.encode(t, add_special_tokens=False).ids) for t in texts]


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(covered)}


QUALITY_TEXTS = [None, "", "  \n\t", "a b a b a b", "x\nx\n\nx\ny é中 #$\n x", PROSE, PROSE * 2, "\xa0 　 a\x0bb", "é" * 2000,
                 "a b c d\na b c d\n", " ".join(str(i % 7) for i in range(200))]


def test_rule_counts_equal_brute_force():
    got = quality.rule_counts(*utf8(pa.array(QUALITY_TEXTS, pa.string())))
    for k, t in enumerate(QUALITY_TEXTS):
        assert {c: int(got[c][k]) for c in brute_counts(t)} == brute_counts(t), repr(t)


def labelled(spark, n=120):
    clean = [f"{PROSE} {sentence(i, 30 + i % 9)} {PROSE[:i % 90]}" for i in range(n)]
    junk = [" ".join(f"{w.upper()}!!" if i % 2 else f"{w}###" for w in f"{PROSE} {sentence(i, 30)}".split()) for i in range(n // 6)]
    texts = clean + junk
    labels = spark.createDataFrame([(i, int(i < n)) for i in range(len(texts))], "doc_id long, quality int")
    return docs(spark, texts, ["row", "kept"]), labels, n


def test_forest_rejects_what_is_odd(spark):
    d, labels, n = labelled(spark)
    forest = quality.fit(d, labels)
    verdict = {r.doc_id: r for r in quality.judge(d, forest).collect()}
    assert all(verdict[i].kept == (i < n) for i in verdict)
    assert not any(r.base_failed for r in verdict.values())
    left = quality.keep_good(d, forest)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == set(range(n))
    assert left.filter(F.col("row") != F.concat(F.lit("keep "), "doc_id")).count() == 0


def test_quality_without_labels_or_rows(spark):
    d, labels, _ = labelled(spark, 12)
    forest = quality.fit(d, labels.filter("quality = 7"))
    assert forest.limit is None
    rows = quality.judge(docs(spark, QUALITY_TEXTS), forest).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.judge(d.limit(0), forest).count() == 0
    assert quality.fit(d.limit(0), labels).limit is None


def test_every_labelled_row_counts_in_the_limit(spark):
    n = 8300
    last = {r.id for r in spark.range(n).orderBy(F.xxhash64("id").desc()).limit(60).collect()}
    clean = [f"{PROSE} {sentence(i + n, 30)}" for i in range(n)]
    texts = [" ".join(f"{w}###" for w in t.split()) if i in last else t for i, t in enumerate(clean)]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i not in last)) for i in range(n)], "doc_id long, quality int")
    rejected = quality.judge(d, quality.fit(d, labels)).filter("not kept and not base_failed")
    assert {r.doc_id for r in rejected.collect()} == last


def test_forest_counts_all_rows(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = np.column_stack([rng.beta(1, 9, n), rng.random(n).round(1), np.where(rng.random(n) < 0.05, rng.random(n), 0), np.full(n, 0.2)])
    x[:3, 0] = 1
    rows = spark.createDataFrame([(*map(float, r), True, 0, 0) for r in x], [*quality.FEATURES, "judged", "good", "bad"]).repartition(5)
    forest = quality.grow_forest(rows, n_trees=7)
    assert forest.tree_rows == 256 and len(forest.trees) == 7
    assert all((a == b).all() for s, t in zip(forest.trees, quality.grow_forest(rows.coalesce(1), n_trees=7).trees) for a, b in zip(s, t))
    for t in forest.trees:
        def check(at, inside, depth):
            part = x[inside]
            varied = np.flatnonzero(part.max(0) > part.min(0))
            if t.feature[at] < 0:
                assert depth == 8 or len(part) * 256 <= n or not len(varied)
                assert t.length[at] == pytest.approx(depth + quality.mean_path(len(part) * 256 / n))
                return
            f = t.feature[at]
            assert len(part) * 256 > n and f in varied and part[:, f].min() <= t.limit[at] <= part[:, f].max()
            goes = x[:, f] <= t.limit[at]
            check(t.left[at], inside & goes, depth + 1)
            check(t.right[at], inside & ~goes, depth + 1)
        check(0, np.ones(n, bool), 0)


@pytest.mark.parametrize("seed", range(4))
def test_calibrate_tries_every_score(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 5), rng.randint(0, 3)) for k in sorted({round(rng.random(), 3 + seed % 2 * 3) for _ in range(300)})]
    rows += [(0.9 + k * 1e-9, k % 2, 3) for k in range(20)]
    rows = sorted({r[0]: r for r in rows}.values())
    good, bad = (sum(r[k] for r in rows) for k in (1, 2))
    keep = [0.998, 0.9, 0.5, 0.0][seed]
    best, gain = 0, -2.0
    for k in range(len(rows)):
        good_out, bad_out = (1 - sum(r[j] for r in rows[:k + 1]) / total for j, total in ((1, good), (2, bad)))
        now = bad_out - good_out if good_out <= 1 - keep else -1.0
        if now > gain:
            best, gain = k, now
    expected = (rows[best][0] + rows[min(best + 1, len(rows) - 1)][0]) / 2
    scored = spark.createDataFrame(rows, "score double, good long, bad long")
    assert quality.calibrate(scored, keep) == expected
    assert quality.calibrate(scored.withColumn("bad", F.lit(0))) is None and quality.calibrate(scored.limit(0)) is None


def test_repeated_rows_and_labels_count_each_time(spark):
    d, labels, n = labelled(spark, 12)
    twice = {(r.good, r.bad) for r in quality.examples(d.union(d), labels.union(labels).union(labels.limit(1))).collect()}
    assert twice == {(2, 0), (3, 0), (0, 2)}
    odd = docs(spark, [None, " "], ["row", "kept"]).union(d.withColumn("doc_id", F.lit(None).cast("long")))
    assert quality.examples(odd, labels).count() == 0
