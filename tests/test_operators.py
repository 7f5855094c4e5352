import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import decode, factor, nextword, reduce, sampling, stats, subword, unigram, windows
from glyphmill.plans import flows
from glyphmill.sources import catalog
from glyphmill.streaming import prefix

def ends():
    return F.lit(2), F.lit(3)


def test_windows_golden(spark):
    rows = spark.createDataFrame([(1, [7, 8, 7])], "row_id long, tokens array<int>")
    got = windows.vectors(windows.windows(rows, *ends(), 3), 3).orderBy("pos").collect()
    assert [r.y for r in got] == [7, 8, 7, 3, 3, 3]
    assert [{i: round(v, 5) for i, v in zip(r.indices, r["values"])} for r in got][2] == {2: 1.0, 7: 0.8409, 8: 0.75984}
    assert [r.pos for r in windows.windows(rows, *ends(), 3, 2).orderBy("pos").collect()] == [0, 2, 4]
    wide = windows.vectors(windows.windows(rows, *ends())).collect()
    assert len(wide) == 18 and all(abs(sum(r["values"]) - 9.602738) < 1e-4 for r in wide)
    assert windows.windows(rows.withColumn("tokens", F.array().cast("array<int>")), *ends()).where("y = 3").count() == 15
    with pytest.raises(ValueError):
        windows.windows(rows, *ends(), 3, 0)


def test_two_formulations_of_windows(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5, 9]), (2, [])], "row_id long, tokens array<int>")
    a = {(r.row_id, r.pos, r.token): round(r.weight, 9) for r in windows.exploded(windows.windows(rows, *ends())).collect()}
    b = {(r.row_id, r.pos, r.token): round(r.weight, 9) for r in windows.framed(rows, *ends()).collect()}
    assert a == b


@pytest.mark.parametrize("kind", ["int", "string"])
@pytest.mark.parametrize("width, slide, nearest", [(15, 1, False), (3, 2, True), (1, 1, False)])
def test_sparse_rows_are_the_windows_vectors(spark, monkeypatch, kind, width, slide, nearest):
    monkeypatch.setattr(windows, "ROWS", 7)
    rng = np.random.default_rng(0)
    rows = [(i, [str(x) if kind == "string" else int(x) for x in rng.integers(0, 12, rng.integers(0, 30))]) for i in range(300)] + [(1000, ["é"] if kind == "string" else [99]), (1001, None)]
    frame = spark.createDataFrame(rows, f"row_id long, tokens array<{kind}>")
    bos, eos = ("<s>", "</s>") if kind == "string" else (2, 3)
    plain = windows.vectors(windows.windows(frame.where("tokens IS NOT NULL"), F.lit(bos), F.lit(eos), width, slide), width, nearest)
    a = {(r.row_id, r.pos): (r.y, list(r.indices), [round(v, 5) for v in r["values"]]) for r in plain.collect()}
    b = {(r.row_id, r.pos): (r.y, list(r.indices), [round(v, 5) for v in r["values"]]) for r in windows.sparse_rows(frame, bos, eos, width, slide, nearest_first=nearest).where("row_id <> 1001").collect()}
    assert a.keys() == b.keys()
    assert all(a[k][:2] == b[k][:2] and np.allclose(a[k][2], b[k][2], atol=2e-5) for k in a)
    assert windows.sparse_rows(frame.limit(0), bos, eos).count() == 0


def test_token_statistics(spark):
    rows = spark.createDataFrame([("a b a c",), ("a b",), ("",), ("d",)], "sentence string").withColumn("tokens", stats.white_space(F.col("sentence")))
    r = stats.token_statistics(rows, 10).first()
    assert (r.avg_token_count_per_sentence, r.token_count_variance, r.token_count_median, r.token_count_min, r.token_count_max) == (1.75, 2.1875, 1.5, 0, 4)
    assert r.low_frequency_token_count == 3 and r.low_frequency_token_ratio == 0.3 and r.avg_token_char_length == 0.75
    assert round(r.avg_token_per_char, 6) == 0.559524 and round(r.token_count_stddev, 5) == 1.47902
    none = stats.token_statistics(rows.limit(0), 10).first()
    assert none.token_count_max == 0 and none.avg_token_per_char == 0.0


def test_dense_row_ids(spark):
    got = catalog.with_row_ids(spark.range(100).select((F.col("id") * 7 % 100).alias("k")), "k").orderBy("k").collect()
    assert [r.row_id for r in got] == list(range(1, 101))


def test_dense_row_ids_of_many_rows_with_text(spark, tmp_path):
    """Beyond the size of a range sample, with nulls, ties and repeated rows; read from a stored result."""
    rows = spark.range(400_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows = rows.union(spark.createDataFrame([(None, "a"), (5, None), (5, None)], "k long, text string"))
    catalog.with_row_ids(rows, "k").write.parquet(f"{tmp_path}/rows")
    got = spark.read.parquet(f"{tmp_path}/rows")
    assert got.columns == ["k", "text", "row_id"]
    assert got.agg(F.count("*"), F.countDistinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (400_003, 400_003, 1, 400_003)
    wrong = got.alias("a").join(got.alias("b"), F.col("b.row_id") == F.col("a.row_id") + 1).where("a.k > b.k OR b.k IS NULL")
    assert wrong.count() == 0
    assert catalog.with_row_ids(rows.limit(0), "k").count() == 0


def test_decimals_are_those_of_printf(spark):
    numbers = [0.00125, 0.03125, 0.09375, 1.00005, 0.00005, 0.28125, -0.03125, -1.00005, 2.5, 1e9 + 0.00005, 0.0, 0.99995, 123456.78905]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", catalog.decimals(F.col("x")).alias("s")).orderBy("i")
    assert [r.s for r in got.collect()] == ["%.4f" % x for x in numbers]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from glyphmill.sources import scratch

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
    Context.master = "local[4]"
    assert scratch.shared_folder(Session()).startswith("file://")


def test_reports_round_trip(spark, tmp_path):
    row = spark.createDataFrame([(1, 0.5, True)], "a int, b double, c boolean")
    assert [(r.key, r.value) for r in catalog.key_values(reduce.formatted(row)).orderBy("at").collect()] == [("a", "1"), ("b", "0.5000"), ("c", "true")]
    assert [r.value for r in catalog.info_lines(row).orderBy("line").collect()] == ["a, b, c", "1, 0.5, true"]
    catalog.write_tsv(row, f"{tmp_path}/t")
    assert catalog.read_tsv(spark, f"{tmp_path}/t", "a int, b double, c boolean").first() == row.first()
    with pytest.raises(Exception, match="no vocabulary size"):
        catalog.listed_sizes(spark.createDataFrame([("m/none.db",)], "path string")).collect()


def test_aligned(spark):
    assert windows.assert_aligned(spark.range(3), spark.range(3)).first().aligned
    with pytest.raises(Exception, match="row counts differ"):
        windows.assert_aligned(spark.range(3), spark.range(4)).collect()


def test_svd_and_pca_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(reduce, "PRODUCTS", 500)
    x = np.random.default_rng(0).normal(size=(60, 8)) + np.arange(8)
    f = reduce.dense_features(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v")
    spectrum, v = reduce.svd_spectrum(f, 8, 8)
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([a[1] for a in spectrum], s) and np.isclose(sum(a[2] for a in spectrum), 1)
    assert np.allclose([a[2] for a in spectrum], (x @ v).var(0) / x.var(0).sum())
    assert sorted(np.round(r.reduced, 6) for r in reduce.projected(f, v[:, :1]).collect()) == sorted(np.round(x @ v[:, :1], 6).tolist())
    spectrum, _ = reduce.pca_spectrum(f, 8, 8)
    assert np.allclose([a[1] for a in spectrum], np.linalg.svd(x - x.mean(0), compute_uv=False)) and np.isclose(sum(a[2] for a in spectrum), 1)
    report = reduce.svd_sweep(f, 8, 60, step=2, least=2).collect()
    assert [r.reduced_dim for r in report] == [6, 4, 2] and sum(r.is_min_dim_over_threshold for r in report) <= 1


def test_moments_of_sparse_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(50, rng.integers(0, 9), replace=False).tolist()),) for _ in range(300)]
    rows = [(i, rng.normal(size=len(i)).tolist()) for (i,) in rows]
    x = np.zeros((300, 50))
    for k, (i, v) in enumerate(rows):
        x[k, i] = v
    n, column, gram = reduce.moments(spark.createDataFrame(rows, "indices array<int>, values array<double>"), 50)
    assert n == 300 and np.allclose(column, x.sum(0)) and np.allclose(gram, x.T @ x)
    n, _, gram = reduce.moments(spark.createDataFrame([], "indices array<int>, values array<double>"), 5)
    assert n == 0 and not gram.any()


def test_nucleus_invariants(spark):
    x = np.random.default_rng(1).normal(size=(20, 30)) * 3
    logits = sampling.logits_of(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "s int, v array<double>"), "s", "v")
    got = sampling.nucleus(sampling.softmax(logits), F.lit(10))
    per = got.groupBy("seq").agg(F.sum("p").alias("m"), F.sum("q").alias("q"), F.min("p").alias("least")).collect()
    assert all(r.m >= 0.73005 - 1e-9 and r.m - r.least < 0.73005 and abs(r.q - 1) < 1e-9 for r in per)
    assert sampling.nucleus(sampling.softmax(logits), F.lit(10), 1).count() == 20
    drawn = sampling.draw(got, 3)
    assert drawn.count() == 20 and drawn.join(got, ["seq", "k"]).count() == 20
    with pytest.raises(ValueError):
        sampling.softmax(logits, 0)
    with pytest.raises(ValueError):
        sampling.nucleus(sampling.softmax(logits), F.lit(1), -1)


@pytest.fixture(scope="module")
def small_corpus(spark):
    rng = np.random.default_rng(5)
    words = ["red", "sky", *("".join(rng.choice(list("abcdefghijklmnopqrst"), rng.integers(2, 7))) for _ in range(80))]
    return spark.createDataFrame([(i, " ".join(["red", "sky", *rng.choice(words, 12)])) for i in range(80)], "row_id long, sentence string")


@pytest.fixture(scope="module")
def fitted(spark, small_corpus):
    model = subword.fit_vocabulary(small_corpus, 60)
    ids = subword.encoded(small_corpus, model)
    return model, windows.vectors(windows.windows(ids, *ends(), tokens="ids")).cache()


def test_subwords(spark, small_corpus, fitted, tmp_path):
    model, _ = fitted
    vocab = subword.vocabulary(spark, model)
    assert vocab.count() == 60 and [r.vocab for r in vocab.orderBy("vocab_id").limit(4).collect()] == ["<pad>", "<unk>", "<s>", "</s>"]
    row = subword.encoded(small_corpus, model).first()
    assert len(row.ids) == len(row.tokens) and "".join(row.tokens).replace("▁", " ").strip() == row.sentence
    subword.save_model(spark, model, f"{tmp_path}/m")
    assert subword.load_model(spark, f"{tmp_path}/m") == model
    with pytest.raises(ValueError):
        subword.fit_final_vocabulary(small_corpus, 100)


def as_rows(spark, x, parts=5):
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]
    return spark.createDataFrame(rows, "indices array<int>, values array<double>").repartition(parts)


@pytest.mark.parametrize(("n", "size", "k", "parts"), [(300, 12, 5, 20), (7, 12, 10, 3), (900, 90, 6, 9), (40, 30, 3, 1)])
@pytest.mark.parametrize("centred", [False, True])
def test_decomposition_is_numpys(spark, n, size, k, parts, centred):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(n, size)) * 0.7 ** np.arange(size)) * (rng.random((n, size)) < 0.7)
    mean = x.mean(0) if centred else None
    s, v = factor.decomposed(as_rows(spark, x, parts), size, k, mean)
    want = np.linalg.svd(x - (0 if mean is None else mean), full_matrices=False)[1][:k]
    want = np.concatenate([want, np.zeros(k - len(want))])
    assert np.allclose(s, want, rtol=1e-4, atol=1e-10)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-8)
    got = (x - (0 if mean is None else mean)) @ v
    assert np.allclose(np.linalg.norm(got, axis=0), s, rtol=1e-6, atol=1e-9)


def test_small_singular_values_survive(spark):
    """Values below the root of the rounding unit, where a Gramian has nothing left."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(200, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    true = np.array([1.0, 1e-2, 1e-5, 1e-9, 1e-10, 1e-11])
    x = (u * true) @ v.T
    s, _ = factor.decomposed(as_rows(spark, x), 6, 6)
    assert np.allclose(s, true, rtol=1e-3)
    _, _, gram = reduce.moments(as_rows(spark, x), 6)
    assert not np.allclose(np.sqrt(np.abs(np.linalg.eigvalsh(gram)))[::-1], true, rtol=1e-1)


def test_both_ways_give_one_spectrum(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 14)) * 0.8 ** np.arange(14) + 0.3
    f = as_rows(spark, x)
    for spectrum in (reduce.svd_spectrum, reduce.pca_spectrum):
        (a, v), (b, w) = spectrum(f, 14, 6), spectrum(f, 14, 6, accurate=True)
        assert np.allclose(a, b, atol=1e-8) and np.allclose(np.abs((v * w).sum(0)), 1, atol=1e-8)


def test_many_columns(spark):
    """50,000 columns: the driver holds columns times rank."""
    rng = np.random.default_rng(6)
    factors, rows = rng.normal(size=(4, 40)), []
    for _ in range(300):
        rows.append((list(range(0, 50_000, 1250)), (rng.normal(size=4) @ factors).tolist()))
    f = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    s, v = factor.decomposed(f, 50_000, 6)
    assert np.allclose(s[:4], np.linalg.svd(np.array([r[1] for r in rows]))[1][:4], rtol=1e-6) and (s[4:] < 1e-6).all() and v.shape == (50_000, 6)


def test_statistics_of_sizes_without_rows(spark):
    rows = spark.createDataFrame([("a b b c", ["a", "b", "b", "c"]), ("", []), ("xy", ["x", "y"])], "sentence string, tokens array<string>")
    r = stats.token_statistics(rows, 10).first()
    assert (r.token_count_min, r.token_count_max, r.token_count_median, r.low_frequency_token_count) == (0, 4, 2.0, 5)
    assert np.isclose(r.token_count_variance, np.var([4, 0, 2])) and np.isclose(r.avg_token_char_length, (1 + 0 + 1) / 3) and np.isclose(r.avg_token_per_char, (4 / 7 + 0 + 1) / 3)
    assert [tuple(x)[2:] for x in stats.token_statistics(rows.limit(0), 0).collect()] == [(0.0, 0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0)]


def test_statistics_read_the_corpus_once(spark, tmp_path):
    spark.createDataFrame([("a b", ["a", "b"])], "sentence string, tokens array<string>").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    for report in (stats.token_statistics(rows, 3), stats.token_statistics_by(rows, {3: F.col("tokens"), 4: F.split("sentence", "")})):
        assert report._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_sweep_is_each_model_alone(spark, small_corpus):
    corpus = small_corpus.union(spark.createDataFrame([(900, None), (901, ""), (902, "日本 red日本sky ¤¤ sky")], "row_id long, sentence string")).where("sentence IS NOT NULL")
    models, words = subword.fit_sweep(corpus, [45, 60])
    got = {r.vocab_size: r for r in subword.sweep_statistics(corpus, words, models).collect()}
    for n, model in models.items():
        want = stats.token_statistics(subword.encoded(corpus, model), n).first()
        assert all(np.isclose(a, b) for a, b in zip(got[n], want)), (got[n], want)


def test_draws_follow_their_chances(spark):
    chances = [0.5, 0.3, 0.15, 0.05]
    rows = spark.range(20_000).select(F.col("id").alias("seq"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(p / 4).alias("p")) for k, p in enumerate(chances)))).alias("c")).select("seq", "c.k", "c.p")
    found = {r.k: r.n / 20_000 for r in sampling.draw(rows, 7).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert all(abs(found[k] - p) < 0.015 for k, p in enumerate(chances))
    assert sampling.draw(rows, 7).collect() != sampling.draw(rows, 8).collect()


def all_paths(word, scores, unknown):
    """Every way to write a word as pieces, with its score."""
    if not word:
        return [((), 0.0)]
    out = []
    for k in range(1, len(word) + 1):
        piece = word[:k]
        if piece in scores or k == 1:
            out += [((piece, *rest), scores.get(piece, unknown) + x) for rest, x in all_paths(word[k:], scores, unknown)]
    return out


def test_lattice_against_all_paths():
    rng = np.random.default_rng(8)
    for _ in range(60):
        made = {"".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(9)} | {"a"}
        pieces, words = sorted(made), ["".join(rng.choice(list("abcd"), rng.integers(0, 8))) for _ in range(6)]
        scores, n = rng.normal(-3, 1, len(pieces)), rng.integers(1, 9, len(words))
        lattice, unknown = unigram.Lattice.of(words, unigram.Trie.of(pieces)), scores.min() - unigram.UNKNOWN
        s = lattice.scored(scores, unknown, np.float64)
        row, place, size = lattice.best(s)
        counts, like = lattice.sums(s, n, len(pieces))
        of, total, expected = dict(zip(pieces, scores)), 0.0, np.zeros(len(pieces))
        for i, w in enumerate(words):
            paths = all_paths(w, of, unknown)
            whole = np.logaddexp.reduce([x for _, x in paths])
            total += n[i] * whole
            for path, x in paths:
                for p in path:
                    if p in of:
                        expected[pieces.index(p)] += n[i] * np.exp(x - whole)
            best = tuple(w[p : p + k] for p, k in zip(place[row == i], size[row == i]))
            assert "".join(best) == w and np.isclose(sum(of.get(p, unknown) for p in best), max(x for _, x in paths))
        assert np.isclose(like, total) and np.allclose(counts, expected)


def test_digamma():
    x = np.array([0.5, 1.0, 2.0, 10.0, 1000.0])
    assert np.allclose(unigram.digamma(x), [-1.9635100260214235, -0.5772156649015329, 0.42278433509846713, 2.2517525890667211, 6.907255195648812], atol=1e-10)


@pytest.fixture(scope="module")
def library(spark):
    """The public library's own model of the smallest tables, and their texts."""
    import io

    import sentencepiece

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=(line for t in texts for line in t.split("\n")), model_writer=model, vocab_size=1000, model_type="unigram", pad_id=0, unk_id=1, bos_id=2, eos_id=3, minloglevel=2, max_sentence_length=100000,
    )
    sp = sentencepiece.SentencePieceProcessor(model_proto=model.getvalue())
    return texts, sp, subword.Vocabulary(tuple(sp.id_to_piece(i) for i in range(1000)), tuple(sp.get_score(i) for i in range(1000)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_encoding_is_the_librarys(spark, library):
    """The same ids but for exact ties, which the library settles by how its sums over a whole text happen to be rounded."""
    texts, sp, model = library
    odd = [None, "", " ", "a\u2581b  c\u00a0\u200bd", "\u3000ＡＢ～１２ ｶﾞｽ", "日本 日本x日", "q\x07r\ufeff", "é" * 5000, "x y " * 3000, "!日!", "日日 日"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd + texts)], "row_id int, sentence string")
    got = {r.row_id: r for r in subword.encoded(rows, model).collect()}
    differ = 0
    for i, t in enumerate(odd + texts):
        want = sp.encode(t or "")
        mine = list(got[i].ids)
        differ += want != mine
        assert len(want) == len(mine) and abs(sum(model.scores[k] for k in want) - sum(model.scores[k] for k in mine)) < 1e-2
        assert "".join(got[i].tokens) == sp.normalize(t or "")
    assert differ <= 0.05 * len(texts)
    words = subword.training_words(rows).toPandas().word.tolist()
    row, _, _, ids = model.encode(words)
    single = [[] for _ in words]
    for r, k in zip(row.tolist(), ids.tolist()):
        if k != subword.UNK or not single[r] or single[r][-1] != subword.UNK:
            single[r].append(k)
    # words by themselves
    assert sum(a != b for a, b in zip(sp.encode([w[1:] for w in words]), single)) == 0


def test_sizes_share_the_rounds_that_they_have_in_common(spark, small_corpus, monkeypatch):
    calls = []
    for name in ("seeds", "expected", "pruning_losses"):
        if hasattr(subword, name):
            monkeypatch.setattr(subword, name, lambda *a, f=getattr(subword, name), name=name: calls.append(name) or f(*a))
    alone = [subword.fit_sweep(small_corpus, [n], seed_size=900)[0][n] for n in (60, 45)]
    each = len(calls)
    calls.clear()
    both, _ = subword.fit_sweep(small_corpus, [60, 45], seed_size=900)
    assert calls.count("seeds") == 1 and len(calls) < each
    for n, model in zip((60, 45), alone):
        assert both[n].pieces == model.pieces and np.allclose(both[n].scores, model.scores)


def test_a_fits_words_are_spread(spark, small_corpus):
    """Each round passes over the distinct words, so these lie in as many files as there are slots, however few bytes they are."""
    _, words = subword.fit_sweep(small_corpus, [45], seed_size=900)
    assert len(words.inputFiles()) >= spark.sparkContext.defaultParallelism


def test_products_are_what_logarithms_give():
    """Words of 0 to 400 characters, some of them unknown, in one batch."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdé?"), k)) for k in [*rng.integers(0, 30, 200), 60, 399, 400, 1, 0]]
    pieces = [*"abcd", "ab", "abc", "dd", "éa", "bcdab"]
    scores, n = np.log(rng.random(len(pieces)) / 50), rng.integers(1, 9, len(words))
    lattice = unigram.Lattice.of(words, unigram.Trie.of(pieces))
    s = lattice.scored(scores, scores.min() - unigram.UNKNOWN, np.float64)
    counts, like = lattice.sums(s, n, len(pieces))
    want, likely = lattice._logs(s, n, len(pieces))
    assert np.allclose(counts, want, rtol=1e-9) and np.isclose(like, likely, rtol=1e-12)
    for some in ([], [""], ["a" * 500], ["ab"]):
        small = unigram.Lattice.of(some, unigram.Trie.of(pieces))
        s = small.scored(scores, scores.min() - unigram.UNKNOWN, np.float64)
        ones = np.ones(len(some), np.int64)
        assert np.allclose(small.sums(s, ones, len(pieces))[0], small._logs(s, ones, len(pieces))[0] if some else 0)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_fit_is_as_likely_as_the_librarys(spark, library):
    texts, sp, theirs = library
    corpus = spark.createDataFrame(list(enumerate(texts)), "row_id int, sentence string")
    mine = subword.fit_vocabulary(corpus, 1000)
    words = subword.training_words(corpus).cache()

    def likelihood(model):
        s = np.array(model.scores[4:])
        return subword.expected(words, list(model.pieces[4:]), s - np.logaddexp.reduce(s))[1]

    assert likelihood(mine) > 1.01 * likelihood(theirs)  # negative: at most one percent worse
    assert len(set(mine.pieces) & set(theirs.pieces)) > 800 and len(set(mine.pieces)) == 1000


def test_every_line_enters_the_vocabulary(spark):
    """Two lines with 210,000 copies each: whichever has the smaller hash, the other's words count as much."""
    lines = ["abc abd bcd cda", "xyz xyw yzw zwx"]
    corpus = spark.range(420_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, lines[0]).otherwise(lines[1]).alias("sentence"))
    found = {r.vocab for r in subword.vocabulary(spark, subword.fit_vocabulary(corpus, 16)).collect()}
    assert set("abcdxyzw") <= found
    odd = spark.createDataFrame([(1, "a  b\tc\r\n\na b"), (2, None), (3, "x" * 4193 + " b"), (4, " ")], "row_id long, sentence string")
    assert {r.word: r.n for r in subword.training_words(odd).collect()} == {"▁a": 2, "▁b": 3, "▁c": 1, "▁" + "x" * 4193: 1}


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    w = [a + rng.normal(size=a.shape) / 5 for a in nextword.initial(6, (5, 4), 1)]  # no unit at its kink
    i, v, y = [[0, 2], [3]], [[1.0, 0.5], [2.0]], np.array([1, 4])
    g, loss, _ = nextword.gradient(w, i, v, y)
    for k in range(len(w)):
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        w[k][at] += 1e-5
        more = nextword.gradient(w, i, v, y)[1]
        w[k][at] -= 1e-5
        assert abs((more - loss) / 1e-5 - g[k][at]) < 1e-2


def test_training_and_resuming(spark, fitted, tmp_path):
    _, vectors = fitted
    run = f"file://{tmp_path}/run"
    weights, log = nextword.train(vectors, 60, run, epochs=2, hidden=(16, 8), batch_size=512)
    assert log[1][1] < log[0][1] and nextword.last_saved(spark, run) == 2
    more, log = nextword.train(vectors, 60, run, epochs=3, hidden=(16, 8), batch_size=512, mode="continue")
    assert [r[0] for r in log] == [3] and sorted(r.epoch for r in nextword.run_log(spark, run).collect()) == [1, 2, 3]
    whole, _ = nextword.train(vectors, 60, f"file://{tmp_path}/whole", epochs=3, hidden=(16, 8), batch_size=512)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(more, whole))  # continuing is as good as not having stopped
    same, log = nextword.train(vectors, 60, run, epochs=3, mode="continue", hidden=(16, 8))
    assert log == [(3, -1.0, -1.0)] and all(np.array_equal(a, b) for a, b in zip(more, same))
    with pytest.raises(ValueError):
        nextword.train(vectors, 60, mode="other")


def plain_loop(vectors, vocab, hidden, batch_size, epochs, seed=42):
    """The same training in one process: whole mini-batches, one after another."""
    rows = vectors.select("row_id", "pos", "indices", "values", "y").collect()
    weights = nextword.initial(vocab, hidden, seed)
    vector = nextword.flat(weights)
    adam, steps = nextword.Adam.new(vector.size), -(-len(rows) // batch_size)
    for epoch in range(1, epochs + 1):
        drawn = vectors.select(F.pmod(F.xxhash64("row_id", "pos", F.lit(f"step:{seed}:{epoch}")), F.lit(steps)).alias("s")).collect()
        for step in range(steps):
            some = [r for r, s in zip(rows, drawn) if s.s == step]
            if some:
                g, _, _ = nextword.gradient(nextword.views(vector, [w.shape for w in weights]), [r.indices for r in some], [r["values"] for r in some], np.array([r.y for r in some]))
                adam.step(vector, nextword.flat(g) / len(some))
    return vector


@pytest.mark.parametrize("workers", [1, 2, 3])
def test_tasks_train_as_one_loop(fitted, workers):
    _, vectors = fitted
    some = vectors.where("row_id < 12")
    weights, log = nextword.train(some, 60, epochs=2, hidden=(9, 7), batch_size=40, workers=workers)
    assert np.allclose(nextword.flat(weights), plain_loop(some, 60, (9, 7), 40, 2), atol=2e-4)
    assert len(log) == 2 and 0 <= log[1][2] <= 1


def test_rows_of_a_single_epoch_are_not_stored(fitted, monkeypatch):
    """They go to the tasks as they are made, when their number is known; weights and log are those of stored rows."""
    _, vectors = fitted
    some, options = vectors.where("row_id < 12"), {"epochs": 1, "hidden": (9, 7), "batch_size": 40, "workers": 2}
    weights, log = nextword.train(some, 60, **options)
    stored = []
    monkeypatch.setattr(nextword.Scratch, "save", lambda self, df, name: stored.append(name))
    same, again = nextword.train(some, 60, n_rows=some.count(), **options)
    assert not stored and np.allclose(log, again)
    assert np.allclose(nextword.flat(weights), nextword.flat(same), atol=1e-5)


def test_windows_are_counted_without_making_them(spark):
    rows = spark.createDataFrame([(1, [4, 5, 6]), (2, []), (3, None), (4, list(range(40)))], "row_id long, ids array<int>")
    for width, slide in ((15, 1), (4, 3)):
        assert windows.how_many(rows, width, slide, "ids") == windows.sparse_rows(rows, 2, 3, width, slide, "ids").count()
    assert windows.how_many(rows.where("row_id > 4"), tokens="ids") == 0


@pytest.mark.parametrize("n", [3, 300, 700])
def test_sparse_products(n):
    """Frequent columns go through a dense matrix, seldom ones by themselves, and rows may be empty or long."""
    rng = np.random.default_rng(n)
    indices = [np.sort(rng.choice(np.arange(1, 900), k, False)) for k in rng.choice([0, 1, 5, 14, 60], n)]
    indices = [np.append(0, i) if r % 3 else i for r, i in enumerate(indices)]
    values = [rng.random(len(i)).astype(np.float32) for i in indices]
    x = np.zeros((n, 900))
    for r, (i, v) in enumerate(zip(indices, values)):
        x[r, i] = v
    columns, often, rest = nextword.split(nextword.packed(indices, values))
    assert 0 in columns and often.shape[1] * n <= nextword.OFTEN * sum(map(len, indices))
    assert (len(rest[1]) > 0) == (n > nextword.OFTEN)
    w, d = rng.standard_normal((900, 8)).astype(np.float32), rng.standard_normal((n, 8)).astype(np.float32)
    first, into = often @ w[columns], np.zeros((900, 8), np.float32)
    nextword.add_gathered(w, rest, first)
    assert np.allclose(first, x @ w, atol=1e-4)
    into[columns] += often.T @ d
    nextword.add_scattered(rest, d, into)
    assert np.allclose(into, x.T @ d, atol=1e-3)
    if len(rest[1]):
        with pytest.raises(IndexError):
            nextword.add_gathered(w[:1], rest, first)


class Killed(Exception):
    pass


@pytest.mark.parametrize("write", [0, 1, 2])
def test_killed_between_writes(spark, fitted, tmp_path, monkeypatch, write):
    """Whichever write of the second epoch is the last one, the run goes on as if it had not been killed."""
    _, vectors = fitted
    some, run, options = vectors.where("row_id < 10"), f"file://{tmp_path}/run", {"hidden": (6, 5), "batch_size": 64, "workers": 1}
    table, commit, calls = nextword.weights_table, nextword.commit, []

    def dying(f):
        def g(*a):
            calls.append(f)
            if len(calls) == 4 + write:  # three writes an epoch
                raise Killed
            return f(*a)

        return g

    monkeypatch.setattr(nextword, "weights_table", dying(table))
    monkeypatch.setattr(nextword, "commit", dying(commit))
    with pytest.raises(Killed):
        nextword.train(some, 60, run, epochs=3, **options)
    monkeypatch.undo()
    assert nextword.last_saved(spark, run) == 1
    (tmp_path / "run" / "epoch=2").mkdir(exist_ok=True)  # a folder without rows
    more, log = nextword.train(some, 60, run, epochs=3, mode="continue", **options)
    assert [r[0] for r in log] == [2, 3] and sorted(r.epoch for r in nextword.run_log(spark, run).collect()) == [1, 2, 3]
    whole, _ = nextword.train(some, 60, epochs=3, **options)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(more, whole))


def test_log_without_weights(spark, fitted, tmp_path):
    _, vectors = fitted
    run = f"file://{tmp_path}/run"
    nextword.commit(spark, run, (4, 0.5, 0.25))
    _, log = nextword.train(vectors.where("row_id < 3"), 60, run, epochs=5, mode="continue", hidden=(4, 3), batch_size=64)
    assert [r[0] for r in log] == [5] and nextword.last_saved(spark, run) == 5


def test_generation(spark, fitted):
    model, vectors = fitted
    weights = nextword.initial(60, (16, 8))
    make = lambda seed: decode.generate(decode.seeds_for(spark, "none10"), weights, model, seed=seed).orderBy("seq").collect()
    first = make(1)
    assert first == make(1) and first != make(2)
    assert all(r.ended or r.n_tokens == decode.MOST for r in first)
    line = flows.generate(spark, weights, model, "take", "red sky", seed=1).first().value
    assert line.startswith("▁red▁sky")
    assert flows.generate(spark, weights, model, "none10", seed=1).first().value.startswith("[1] ")
    with pytest.raises(ValueError):
        decode.seeds_for(spark, "take")


def test_context_is_the_training_context(spark):
    ids = [9, 4, 4, 7]
    rows = spark.createDataFrame([(1, ids)], "row_id long, tokens array<int>")
    last = windows.vectors(windows.windows(rows, *ends())).where("pos = 4").first()
    weights = nextword.initial(60, (16, 8))
    logits = decode.logits_of(weights, decode.contexts([ids]))
    assert np.allclose(logits, nextword.forward(weights, [last.indices], [last["values"]])[-1], atol=1e-5)
    strange = decode.contexts([[70, -1, 4, 7]])
    assert np.isfinite(decode.logits_of(weights, strange)).all()


def one_by_one(weights, seed_ids, drawn, top_k, temperature):
    """The rule as it reads, a sequence and a token at a time."""
    ids = list(seed_ids)
    for u in drawn:
        z = decode.logits_of([w.astype(np.float64) for w in weights], decode.contexts([ids]))[0] / temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        order = sorted(range(len(p)), key=lambda k: (-p[k], -k))
        mass, upto, kept = max(0.99 * 0.97 ** len(ids), 0.4), 0.0, []
        for k in order:
            if kept and upto >= mass or top_k and len(kept) == top_k:
                break
            kept.append(k)
            upto += p[k]
        share = np.cumsum(p[kept]) / p[kept].sum()
        ids.append(kept[min(int((share <= u).sum()), len(kept) - 1)])
        if ids[-1] == subword.EOS:
            break
    return ids


@pytest.mark.parametrize(("top_k", "temperature"), [(2, 1.0), (0, 0.7), (5, 2.0)])
def test_sequences_advance_together_as_alone(top_k, temperature):
    rng = np.random.default_rng(4)
    weights = [w * 3 for w in nextword.initial(30, (16, 8), 3)]
    seeds = [[], [4, 5], [3] * 20, list(range(4, 30)), [7]]
    drawn = rng.random((len(seeds), 25))
    found = decode.sequences(weights, seeds, drawn, top_k, temperature)
    assert found == [one_by_one(weights, s, u, top_k, temperature) for s, u in zip(seeds, drawn)]
    assert found[1:] == decode.sequences(weights, seeds[1:], drawn[1:], top_k, temperature)


def test_pick_keeps_the_nucleus(spark):
    """The candidates of a draw are those of the rule over long rows."""
    rng = np.random.default_rng(1)
    logits, length = rng.normal(size=(6, 20)).round(1) * 2, np.array([0, 1, 5, 20, 30, 90])
    for i in range(6):
        rows = spark.createDataFrame([(i, k, float(x)) for k, x in enumerate(logits[i])], "seq int, k int, logit double")
        kept = {r.k for r in sampling.nucleus(sampling.softmax(rows), F.lit(int(length[i]))).collect()}
        u = np.linspace(0, 0.999999, 4000)
        got = decode.pick(np.repeat(logits[i : i + 1], len(u), 0), np.repeat(length[i], len(u)), u, 0)
        assert set(got.tolist()) == kept


def test_streaming_prefix_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b ー"), (2, "c")], "row_id long, sentence string")
    rows.write.parquet(f"{tmp_path}/in")
    prefix.write(prefix.normalized_windows(prefix.read(spark, f"{tmp_path}/in"), 3), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    key = lambda r: (r.row_id, r.pos)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=key) == sorted(prefix.normalized_windows(rows, 3).collect(), key=key)


def test_encoding_and_vectors_on_a_stream(spark, small_corpus, fitted, tmp_path):
    model, _ = fitted
    small_corpus.repartition(3).write.parquet(f"{tmp_path}/in")
    for name, step in (("ids", lambda r: prefix.encoded(r, model)), ("rows", lambda r: prefix.vectors(r, model, 5, 2))):
        prefix.write(step(prefix.read(spark, f"{tmp_path}/in")), f"{tmp_path}/{name}", f"{tmp_path}/ck-{name}").awaitTermination(120)
        assert sorted(map(str, spark.read.parquet(f"{tmp_path}/{name}").collect())) == sorted(map(str, step(small_corpus).collect()))


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_lookups(spark, monkeypatch, most):
    monkeypatch.setattr(catalog, "LOOKUP_ROWS", most)
    names = spark.createDataFrame([(f"w{i}", i) for i in range(9)], "token string, id int")
    rows = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "w0").otherwise(F.concat(F.lit("w"), (F.col("id") % 12).cast("string"))).alias("token")).withColumnRenamed("id", "at")
    got = catalog.looked_up(rows, names, "token", 9)
    want = sorted((i, n) for i in range(500) for n in ([0] if i % 3 == 0 else [i % 12]) if n < 9)
    assert sorted((r["at"], r.id) for r in got.collect()) == want


def test_counted_while_written(spark, tmp_path):
    assert catalog.write_counted(spark.range(77), f"{tmp_path}/t") == 77 == spark.read.parquet(f"{tmp_path}/t").count()
    assert catalog.write_counted(spark.range(0), f"{tmp_path}/t") == 0


def test_flows(spark, small_corpus, tmp_path):
    store = catalog.Catalog(f"file://{tmp_path}/store")
    corpus = flows.prepare(spark, small_corpus, store)
    assert flows.sweep(spark, corpus, [40, 60], store).count() == 2
    model = subword.load_model(spark, store.path("model", vocab_size=60))
    vectors = flows.vectorise(spark, corpus, model, store)
    assert flows.compress(spark, vectors, 60, store, step=20, least=20).count() == 2
    assert catalog.read_tsv(spark, store.path("token_statistics"), "vocab_size int, mean double").count() == 2


def test_commands(spark, tmp_path, monkeypatch, capsys):
    from glyphmill.__main__ import main, parser

    rng = np.random.default_rng(3)
    words = ["price", "2016", *("".join(rng.choice(list("aeionrstlm"), rng.integers(3, 9))) for _ in range(300))]
    docs = [(i, " ".join(rng.choice(words, 12)), f"s{i % 2}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(subword, "MIN_VOCAB", 40)
    monkeypatch.setattr(nextword, "HIDDEN", (8, 4))

    def said(*argv):
        assert main(["--root", f"file://{tmp_path}/store", *argv], spark) == 0
        return capsys.readouterr().out

    tables = ("--tables", str(tmp_path))
    assert "sentence: string" in said("describe", *tables) and said("prepare", *tables) == "60 sentences\n"
    assert len(said("compare", *tables, "--sample", "4").splitlines()) == 5
    assert len(said("weights", "--most", "3").splitlines()) == 4
    assert len(said("sweep", "--low", "30", "--high", "40", "--steps", "2").splitlines()) == 3
    assert said("vocabulary", "--size", "40").startswith("vocab_size, ")
    n = int(said("vectorise", "--slide", "2").split()[0])
    assert n == spark.read.parquet(f"{tmp_path}/store/context_windows").count() > 60
    assert len(said("windows", "--sample", "3").splitlines()) == 4
    assert len(said("svd", "--step", "10", "--least", "10").splitlines()) == 4 and spark.read.parquet(f"{tmp_path}/store/svd_model").count() == 30
    assert "explained_variance_rate" in said("pca", "--dim", "5") and spark.read.parquet(f"{tmp_path}/store/pca_model/dim=5").count() == 5
    assert said("train", "--epochs", "1", "--batch", "4096").startswith("1\t")
    assert said("train", "--epochs", "1", "--mode", "continue") == "1\t-1.00000000\t-1.00000000\n"
    assert len(said("generate", "--mode", "none10").splitlines()) == 10 and said("generate", "--mode", "take", "--text", "PRICE")
    assert "sparse_categorical_accuracy" in said("view", "--report", "training_log")
    for wrong in (["vocabulary", "--size", "39"], ["vectorise", "--width", "0"], ["generate", "--mode", "other"], []):
        with pytest.raises(SystemExit):
            parser().parse_args(wrong)
    monkeypatch.delenv("GLYPHMILL_ROOT", raising=False)
    with pytest.raises(SystemExit):
        main(["weights"], spark)


def test_stored_artifacts_are_listed(spark, tmp_path):
    for name in ("a_tokenized_1400.db", "a_tokenized_10000.db", "notes.txt"):
        (tmp_path / name).write_text("x")
    assert [r.vocab_size for r in catalog.listed_sizes(catalog.stored_paths(spark, str(tmp_path))).collect()] == [1400, 10000]
    names = spark.createDataFrame([("x/next_word_model_epoch_3.h5",), ("old_next_word_model_epoch_9.h5",), ("next_word_model_epoch_4.parquet",)], "name string")
    assert catalog.latest_checkpoint(names).first().epoch == 3


def test_framed_rows_add_up_in_place(spark):
    """The frame's rows equal the sparse ones, repeated tokens included, and no entry becomes a row that is grouped again."""
    rows = spark.createDataFrame([(1, ["b", "a", "b", "b", "c", "a"]), (2, []), (3, [f"t{k % 7}" for k in range(60)]), (4, [f"u{k}" for k in range(40)])], "row_id long, tokens array<string>")
    found = windows.framed_rows(rows, F.lit("<s>"), F.lit("</s>"))
    want = {(r.row_id, r.pos): (list(r.indices), [round(x, 9) for x in r["values"]]) for r in windows.sparse_rows(rows, "<s>", "</s>").collect()}
    got = {(r.row_id, r.pos): (list(r.indices), [round(x, 9) for x in r["values"]]) for r in found.collect()}
    assert got == want and len(got) == 6 + 60 + 40 + 4 * 15
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate " not in plan and plan.count("Generate") == 1


def test_pieces_are_looked_up_by_one_join_of_the_corpus(spark, monkeypatch):
    from glyphmill import queries

    calls, looked_up = [], queries.catalog.looked_up
    monkeypatch.setattr(queries.catalog, "looked_up", lambda *a: calls.append(a) or looked_up(*a))
    monkeypatch.setattr(queries.catalog, "LOOKUP_ROWS", 0)
    got = queries.piece_lookup(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    tokens = queries.split_documents(spark, "/root/testdata/sf0.001").collect()
    number = {t: k for k, t in enumerate(sorted({t for r in tokens for t in r.tokens or []}))}
    want = sorted((r.row_id, k, number[t], t) for r in tokens for k, t in enumerate(r.tokens or []))
    assert sorted((r.row_id, r.place, r.vocab_id, r.piece) for r in got.collect()) == want


def test_sums_of_products_in_place_and_sorted(spark, monkeypatch):
    """Columns of a row in any order, rows of several widths, and bounds that are passed many times: both ways give the Gramian."""
    rng = np.random.default_rng(5)
    x, rows = np.zeros((300, 40)), []
    for k in range(300):
        at = rng.permutation(40)[: rng.integers(0, 9)]
        x[k, at] = rng.normal(size=len(at))
        rows.append(([int(i) for i in at], [float(v) for v in x[k, at]]))
    frame = spark.createDataFrame(rows, "indices array<int>, values array<double>")
    for held, dense in ((reduce.PRODUCTS, reduce.DENSE), (64, reduce.DENSE), (64, 0)):
        monkeypatch.setattr(reduce, "PRODUCTS", held)
        monkeypatch.setattr(reduce, "DENSE", dense)
        n, column, gram = reduce.moments(frame, 40)
        assert n == 300 and np.allclose(column, x.sum(0)) and np.allclose(gram, x.T @ x)


def test_registered_training_is_the_whole_one(spark, monkeypatch):
    """train_log and generated_text train for as many epochs and in such mini-batches as the network's own run, and windows aren't stored."""
    from glyphmill import queries

    calls, saved = [], []
    rows = spark.createDataFrame([(1, [5, 6, 5, 9]), (2, [])], "row_id long, ids array<int>")
    monkeypatch.setattr(queries, "_ids", lambda *a: rows)
    monkeypatch.setattr(nextword, "run_epoch", lambda w, adam, steps, dealt: (calls.append((steps, dealt.count())), (w, adam, 1.0, 0, 34))[1])
    monkeypatch.setattr(nextword.Scratch, "save_counted", lambda *a: saved.append(a))
    _, log = queries._trained.__wrapped__("test", "/nowhere")
    assert [r[0] for r in log] == list(range(1, 51)) and calls == [(1, 34)] * 50 and not saved
    assert nextword.BATCH == 256


@pytest.mark.parametrize("width", [1, 4, 15])
def test_moments_of_windows_without_making_them(spark, monkeypatch, width):
    """Short, empty and null rows, repeated tokens and marks inside a text; held whole or sorted, with bounds that are passed many times."""
    rng = np.random.default_rng(7)
    rows = [(k, [int(i) for i in rng.integers(0, 12, rng.integers(0, 50))]) for k in range(60)] + [(100, []), (101, None), (102, [5] * 40)]
    ids = spark.createDataFrame(rows, "row_id long, ids array<int>").repartition(3)
    vectors = windows.sparse_rows(ids, 2, 3, width, tokens="ids")
    want = reduce.moments(reduce.sparse_features(vectors), 12)
    for held, dense in ((reduce.PRODUCTS, reduce.DENSE), (64, reduce.DENSE), (64, 0), (reduce.PRODUCTS, 0)):
        monkeypatch.setattr(reduce, "PRODUCTS", held)
        monkeypatch.setattr(reduce, "DENSE", dense)
        n, column, gram = reduce.window_moments(ids, 12, 2, 3, width)
        assert n == want[0] == vectors.count() and np.allclose(column, want[1], rtol=1e-12) and np.allclose(gram, want[2], rtol=1e-12)
    a, b = (reduce.svd_spectrum(reduce.sparse_features(vectors), 12, 8, sums=s)[0] for s in (None, (n, column, gram)))
    assert np.allclose(a, b)


def test_reports_make_no_windows(spark, monkeypatch):
    """Both reports sum up the pieces' ids: no row of the context vectors is made."""
    from glyphmill import queries

    rows = spark.createDataFrame([(k, [4 + (k * j) % 90 for j in range(80)]) for k in range(30)], "row_id long, ids array<int>")
    monkeypatch.setattr(queries, "_ids", lambda *a: rows)
    monkeypatch.setattr(reduce, "moments", lambda *a: pytest.fail("windows are made"))
    assert queries.pca_report(spark, "/nowhere").count() == 9 and queries.svd_report(spark, "/nowhere").count() == 2


def test_framed_rows_sum_stretches(spark):
    """A window's weights are summed by stretches of the sorted entries, each entry once; none is lost, not even of a null token."""
    rows = spark.createDataFrame([(1, ["b", None, "b", "b", None, "a"]), (2, ["x"] * 40)], "row_id long, tokens array<string>")
    found = windows.framed_rows(rows, F.lit("<s>"), F.lit("</s>"))
    assert all(abs(sum(r["values"]) - sum(windows.weight_literals(15))) < 1e-9 and len(r.indices) == len(r["values"]) for r in found.collect())
    assert "filter(s" not in found._jdf.queryExecution().optimizedPlan().toString()
