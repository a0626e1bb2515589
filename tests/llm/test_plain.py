"""Model operators against plain loops: log-likelihood ratios, mixtures, the random field, long texts, the pipeline."""

import random
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))
import plain
from test_neardup import brute as near_classes
from test_quality import brute as base_measures

from quillspark.llm import kernels as K, language, neardup, packing, quality, store, toxicity

R = random.Random(11)
VOCAB = {
    "en": "the house of green hills and rivers was built where seven roads meet under an old bridge".split(),
    "de": "das haus der grünen hügel und flüsse wurde gebaut wo sieben straßen sich unter einer alten brücke treffen".split(),
    "es": "la casa de las colinas verdes y los ríos fue construida donde siete caminos se cruzan bajo un viejo puente".split(),
}


def words(lang, n):
    return " ".join(R.choice(VOCAB[lang]) + R.choice(["", "", str(R.randrange(40))]) for _ in range(n))


def test_ratio_equals_a_dictionary(spark):
    texts = [words(R.choice("en de es".split()), R.randrange(1, 90)) for _ in range(60)] + [None, "", "one"]
    trusted = set(range(0, 60, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.llr for r in quality.judge(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    want = plain.ratios(texts, trusted)
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_trusted_rows_are_chosen_by_hash(spark, monkeypatch):
    monkeypatch.setattr(quality, "MAX_TRUSTED", 5)
    docs = spark.createDataFrame([(i, words("en", 30)) for i in range(40)], "doc_id long, text string")
    ids = spark.range(40).withColumnRenamed("id", "doc_id")
    a, b = quality.fit(docs, ids), quality.fit(docs.repartition(7), ids.repartition(9))
    assert np.array_equal(a, b)


def test_mixtures_equal_plain_loops(spark):
    train = [(words(lang, 60), lang) for lang in VOCAB for _ in range(8)]
    names, logp = language.fit(spark.createDataFrame(train, "text string, lang string"))
    own, plainly = plain.fit_languages(train)
    assert names == own
    assert np.allclose(logp[plain.buckets(b"the house")], [plainly(g) for g in plain.buckets(b"the house")], atol=1e-5)
    texts = [words("en", 40), words("de", 25) + "\n" + words("es", 30), words("en", 30) + " " + words("de", 30) + " " + words("es", 30), "the", "", "  ", "zzz qqq", words("es", 300)]
    buf, offs = K.string_buffer(pa.array(texts))
    share, chosen = language.infer(buf, offs, logp)
    for i, t in enumerate(texts):
        want, which = plain.mixture(t, names, plainly)
        assert np.flatnonzero(chosen[i]).tolist() == which and np.allclose(share[i], want, atol=2e-3), t
        alone, _ = language.infer(*K.string_buffer(pa.array([t])), logp)
        assert np.allclose(alone[0], share[i], atol=1e-4)  # neighbours in a chunk do not matter


def test_windows_of_a_long_text_change_nothing(monkeypatch):
    text = words("en", 3_000) + " " + words("de", 2_000)
    buf, offs = K.string_buffer(pa.array([text]))
    logp = np.log(np.random.default_rng(3).random((1 << language.BITS, 3))).astype(np.float32)
    s, e, _ = K.words(buf, offs)
    want, like = K.span_hashes(buf, s, e), language.infer(buf, offs, logp)[0]
    monkeypatch.setattr(K, "CHUNK_BYTES", 700)
    monkeypatch.setattr(language, "SLICE", 100)
    K._POW.clear()
    assert np.array_equal(K.span_hashes(buf, s, e), want)
    assert np.array_equal(K.span_hashes(buf, s[::-1], e[::-1]), want[::-1])
    assert np.allclose(language.infer(buf, offs, logp)[0], like, atol=1e-4)
    K._POW.clear()


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(2)
    weight, trans = r.normal(size=50), r.normal(size=(2, 2))
    lengths = [1, 2, 3, 5, 8, 1, 10]
    bucket, starts = r.integers(0, 50, sum(lengths)), np.cumsum([0, *lengths[:-1]])
    p, pairs, logz = toxicity.marginals(weight, trans, bucket, starts)
    want = [plain.field(weight[bucket[a : a + n]], trans) for a, n in zip(starts, lengths)]
    assert np.allclose(p, np.concatenate([w[0] for w in want]))
    assert np.allclose(pairs, sum(w[1] for w in want)) and np.isclose(logz, sum(w[2] for w in want))
    assert np.allclose(toxicity.scored(weight, trans, bucket, starts), p)


def test_training_climbs_the_likelihood():
    """The gradient that training follows is that of the enumerated conditional log-likelihood."""
    r = np.random.default_rng(7)
    bucket, starts, gold = r.integers(0, 4, 12), np.array([0, 5, 9]), r.integers(0, 2, 12)
    weight, trans, eps = r.normal(size=4), r.normal(size=(2, 2)), 1e-5

    def value(w):
        out = 0.0
        for a, b in zip(starts, [5, 9, 12]):
            tags = gold[a:b]
            out += w[bucket[a:b]][tags == 1].sum() + sum(trans[x, y] for x, y in zip(tags, tags[1:])) - plain.field(w[bucket[a:b]], trans)[2]
        return out

    p, *_ = toxicity.marginals(weight, trans, bucket, starts)
    for k in range(4):
        up, down = weight.copy(), weight.copy()
        up[k] += eps
        down[k] -= eps
        assert np.isclose((value(up) - value(down)) / (2 * eps), (gold - p)[bucket == k].sum(), atol=1e-6)


def test_sequences_without_known_words_are_looked_up(monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 7)
    r = np.random.default_rng(1)
    bucket, starts, trans = r.integers(0, 50, 120), np.array([0, 5, 6, 20, 21, 22, 40, 90, 100]), r.normal(size=(2, 2))
    known = np.arange(50) < 4
    weight = np.where(known, r.normal(size=50), -1.3)
    want = toxicity.marginals(weight, trans, bucket, starts)[0]
    assert np.allclose(toxicity.scored(weight, trans, bucket, starts), want) and np.allclose(toxicity.scored(weight, trans, bucket, starts, known, toxicity._alone(-1.3, trans, 60)), want)
    assert len(toxicity.scored(weight, trans, bucket[:0], starts[:0], known, None)) == 0


def test_counted_sequences_are_their_copies():
    """Sequences that count several times have the gradient of so many copies; folds that a model leaves out have none."""
    r = np.random.default_rng(2)
    own = [r.integers(0, 4, n) for n in (3, 1, 5, 2)]
    times, toxic, fold = np.array([2, 3, 1, 2]), np.array([1, 0, 1, 1]), np.array([0, 1, 2, 0])
    f = toxicity.Fields.new(np.array([[True, False, True], [False, True, True]]), np.array([-1, 0]))
    f.w, f.trans = r.normal(size=f.w.shape), r.normal(size=f.trans.shape)
    flat = lambda seqs: (np.concatenate(seqs), np.cumsum([0] + [len(s) for s in seqs])[:-1])
    got = f.gradient(*flat(own), toxic, fold, times)
    copies = np.repeat(np.arange(4), times)
    assert np.allclose(got, f.gradient(*flat([own[i] for i in copies]), toxic[copies], fold[copies], np.ones(len(copies), int)))
    assert np.allclose(got[1], f.gradient(*flat([own[i] for i in (1, 2)]), toxic[[1, 2]], fold[[1, 2]], times[[1, 2]])[1])


def test_parts_train_the_same_field(spark, monkeypatch):
    rows = [(i, words("en", 30) + (" vile rot. " if i % 3 == 0 else " fine. ") + words("en", 10), int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    monkeypatch.setattr(toxicity, "STEPS", 6)
    one = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    monkeypatch.setattr(toxicity, "PART_TOKENS", 400)
    many = toxicity.fit(docs.repartition(5), docs.select("doc_id", "toxic"))
    assert one["known"].sum() >= 2 and np.array_equal(one["known"], many["known"])
    assert np.allclose(one["w"], many["w"], atol=1e-4) and np.allclose(one["trans"], many["trans"], atol=1e-6) and np.allclose(one["c"], many["c"], atol=1e-4)


def test_memory_of_a_text_of_24_mb():
    text = " ".join(np.random.default_rng(0).choice([f"w{i}x" for i in range(5_000)], 4_000_000).tolist())
    column = pa.array([text])
    buf, offs = K.string_buffer(column)

    class Model:
        value = np.zeros(1 << quality.BITS)

    logp = np.zeros((1 << language.BITS, 8), np.float32)
    for work in (
        lambda: list(quality._score(Model, 0.0)(iter([pa.record_batch([pa.array([1]), column], names=["a", "b"])]))),
        lambda: language.infer(buf, offs, logp),
        lambda: toxicity.tokens(buf, offs),
        lambda: neardup.signatures(*neardup.shingles(buf, offs)),
        lambda: packing.encode(buf, offs, packing.vocabulary_path()),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 800e6


def test_pipeline_stage_by_stage(spark, tmp_path):
    """corpus_pipeline over a small table: what every stage keeps, by plain loops, then the pieces by the tokenizer."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = []
    for i in range(90):
        lang = R.choice(list(VOCAB))
        rows.append((i, words(lang, R.randrange(60, 140)), lang, "src", 1))
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " tail", rows[i][2], "copy", 1) for i in range(12)]
    rows += [(200 + i, " ".join(R.choice("#$ %% && ** zx qk jw".split()) for _ in range(80)), "en", "junk", 1) for i in range(12)]
    rows += [(300, None, None, None, None), (301, "", "en", "x", 0), (302, "short text", "en", "x", 2), (303, "12345 " * 3 + " ".join(map(str, range(80))), None, "digits", 1), (None, rows[5][1], "en", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)] + [(200, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["quality", "language", "neardup", "packing"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    llr = plain.ratios([r[1] for r in rows], set(range(60)))
    kept = [r for r, x in zip(rows, llr) if not base_measures(r[1])[5] and x >= quality.THRESHOLD]
    docs = store.table(corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)), "test")
    assert key(docs) == sorted(((r[0], r[1]) for r in kept), key=str) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r[0] for r in kept} >= {0, 1, 2} and not {200, 300, 301, 302} & {r[0] for r in kept}

    fold = [tuple(r) for r in language.training_fold(docs).where("lang is not null").select("text", "lang").collect()]
    langs, logp = plain.fit_languages(fold)
    kept = [r for r in kept if any(c.isalpha() for c in r[1]) and max(plain.mixture(r[1], langs, logp)[0]) >= language.LEAST_SHARE]
    docs = store.table(corpus_pipeline.STAGES[1][1](spark, docs, str(tmp_path)), "test")
    assert key(docs) == sorted(((r[0], r[1]) for r in kept), key=str)

    known = [(r[0], r[1]) for r in kept if r[0] is not None]
    kept = [r for r in known if r[0] in set(near_classes(known))] + [(r[0], r[1]) for r in kept if r[0] is None]
    docs = store.table(corpus_pipeline.STAGES[2][1](spark, docs, str(tmp_path)), "test")
    assert key(docs) == sorted(kept, key=str)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = sorted(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for _, t in kept)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.length for r in got) == sizes and {r.doc_id for r in got} == {i for i, _ in kept}
    assert sum(sizes) <= 2048 * len({r.sequence_id for r in got})
