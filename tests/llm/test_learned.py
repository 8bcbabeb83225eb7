"""Classifiers on held-out rows, mixing, neighbours and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trajq.llm import common, labelled, mixing, near, neighbours, quality, queries, toxicity

LARGER = "/root/testdata/sf0.1"


def held_out(spark, got, label, sf):
    rows = got.join(queries.labels(spark, sf), "doc_id").where(f"held_out and {label} is not null").toPandas()
    return rows, [(rows[rows[label] == y].predicted == y).mean() for y in (0, 1)]


def test_quality_on_held_out_rows(spark):
    _, right = held_out(spark, queries.op3_quality(spark, LARGER), "quality", LARGER)
    assert min(right) > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = queries.op8_toxicity(spark, LARGER)
    rows, right = held_out(spark, got, "toxic", LARGER)
    assert right[0] > 0.97 and right[1] > 0.85  # a tenth of the labels is noise
    assert rows.score.between(0, 1).all() and got.count() == queries.documents(spark, LARGER).count()


@pytest.mark.parametrize("module, of, held", [(quality, 3, 1), (toxicity, 5, 0)])
def test_classifiers_of_odd_rows(spark, odd, none, module, of, held):
    import zlib

    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (104, 7, 7)], "doc_id long, quality int, toxic int")
    label = "quality" if module is quality else "toxic"
    model = module.fit(odd, labels, label, of, held)
    rows = labelled.graded(module.score(odd, model), of, held).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % of == held) for r in rows)
    assert module.score(none, model).count() == 0
    one = module.fit(odd, labels.where(f"{label} = 1"), label, of, held)
    assert {r["score"] for r in module.score(odd, one).collect()} == {1.0}
    nothing = module.fit(odd, labels.limit(0), label, of, held)
    assert module.score(odd, nothing).count() == odd.count()
    if module is toxicity:
        assert toxicity.kept(odd, nothing).count() == odd.count() and toxicity.kept(odd, model).columns == odd.columns


def test_thresholds_of_scores():
    assert 0.3 < toxicity.cut(np.array([0.1, 0.2, 0.3, 0.8]), np.array([0, 0, 0, 1])) < 0.8
    assert quality.quantile_cut(np.array([0.0, 1.0, 2.0, 3.0]), np.array([0, 0, 1, 1]), 0.1) == 1.5


def labelled_rows(spark, n):
    """Noisy documents of both labels, more than 2000 of label 1, in two languages."""
    rng = np.random.default_rng(3)
    y = (rng.random(n) < 0.85).astype(int)
    texts = [" ".join(f"{'Ab' if rng.random() < 0.3 + 0.3 * good else 'cd7'}{rng.integers(40)}" for _ in range(rng.integers(3, 25))) for good in y]
    langs = [("en", "de")[i % 2] for i in range(n)]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(v), int(v)) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    return docs, labels, texts, np.array(y), np.array(langs)


def learned_from(n, of, held):
    import zlib

    return np.array([zlib.crc32(str(i).encode()) % of != held for i in range(n)])


def test_quality_learns_from_all_labelled_rows(spark):
    docs, labels, texts, y, _ = labelled_rows(spark, 4500)
    own = learned_from(len(y), 3, 1)
    assert (y[own] == 1).sum() > 2000
    x = quality.features([t for t, k in zip(texts, own) if k])
    model = quality.fit(docs, labels)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0) + 1e-3)
    assert model.threshold == pytest.approx(quality.quantile_cut(model.rank(x), y[own], (y[own] == 0).mean()), abs=1e-9)


def test_toxicity_learns_from_all_labelled_rows(spark):
    docs, labels, texts, y, langs = labelled_rows(spark, 3600)
    own = learned_from(len(y), 5, 0)
    assert (y[own] == 1).sum() > 2000
    rows = labelled.gathered(docs, labelled.training(labels, "toxic", 5, 0), toxicity.sample_features, 500)
    assert rows.count() == own.sum() and rows.select("block").distinct().count() == -(-own.sum() // 500)
    x = toxicity.sample_features([t for t, k in zip(texts, own) if k])
    for k, seen in enumerate(toxicity.word_counts(rows)):
        want = np.zeros_like(seen)
        for t, label in zip(x, y[own]):
            want[label, np.unique(t[:, k])] += 1
        assert (seen == want).all()
    model = toxicity.fit(docs, labels, epochs=1)
    p = model.score_rows(x)
    assert model.threshold == pytest.approx(toxicity.cut(p, y[own]), abs=1e-6)
    for lang in ("en", "de"):
        at = langs[own] == lang
        assert model.thresholds[lang] == pytest.approx(toxicity.cut(p[at], y[own][at]), abs=1e-6)


def test_blocks_are_averaged(spark):
    """Blocks in any tasks give the same model, and one that differs from a block's own."""
    docs, labels, *_ = labelled_rows(spark, 400)
    rows = labelled.gathered(docs, labelled.training(labels, "toxic", 5, 0), toxicity.sample_features, 80)
    n = labelled.classes(rows)
    state, weight = toxicity.start(rows, n[0], n[1]), np.ones(2)
    a, b = (toxicity.epoch(r, state, weight, 0) for r in (rows, rows.coalesce(1)))
    assert all((x == y).all() for x, y in zip([*a.dense(), *a.model.tables, *a.speed, *a.moments], [*b.dense(), *b.model.tables, *b.speed, *b.moments])) and a.step == b.step > 0


def test_workers_get_small_batches(spark, monkeypatch):
    """What Spark hands a worker at once is bounded by bytes, and so is what it is sent with a function."""
    import pickle

    def watched(batches, *args, **kw):
        for batch in batches:
            assert batch.nbytes < 2 * common.BATCH_BYTES
            yield batch

    for module in (labelled, toxicity, near):
        monkeypatch.setattr(module, "slices", watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 8000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.lit(" word" * 300)).alias("text"), F.lit("en").alias("lang"))
    model = toxicity.Model([], [], [], np.zeros(0), np.zeros(1), constant=0.0)
    assert toxicity.score(docs, model).count() == toxicity.kept(docs, model).count() == near.sketched(docs).count() == 8000
    words = common.Words(letters=True)
    sent = pickle.dumps(words)
    assert len(sent) < 100_000
    assert all((x == y).all() for x, y in zip(words.of_texts([b"One two", b"three"]), pickle.loads(sent).of_texts([b"One two", b"three"])))


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_of(sizes):
    """Brute force: share by weight, stop at twice the source, share the excess again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / total for s in free}
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        free -= above
    return target


def check_mix(docs, got, near_by=None):
    source = {}
    sizes = {}
    for r in docs.select("doc_id", "source", "text").collect():
        source.setdefault(r["doc_id"], r["source"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
    want = targets_of(sizes)
    rows = got.collect()
    assert len(rows) == docs.count()
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        taken[s] = taken.get(s, 0) + r["taken"]
    if near_by:
        assert all(abs(taken[s] - want[s]) <= near_by * want[s] for s in want)
    return sorted(tuple(r) for r in rows if r["doc_id"] is not None)


def test_query_of_mixing(spark, sf):
    first = check_mix(queries.documents(spark, "/root/testdata/sf0.01"), queries.op6_mixing(spark, "/root/testdata/sf0.01"), near_by=0.05)
    assert first == sorted(tuple(r) for r in queries.op6_mixing(spark, "/root/testdata/sf0.01").collect())


def test_mixing_of_odd_rows(odd, none):
    assert check_mix(odd, mixing.plan(odd)) == check_mix(odd, mixing.plan(odd.repartition(5)))
    assert mixing.plan(none).count() == 0 and mixing.mixed(none).count() == 0
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns


def test_inclusion_follows_the_probabilities(make):
    rows = [(i, " ".join(["w"] * (1 + 7 * (i % 2))), "en", s) for s in "abcd" for i in range(ord(s) * 10_000, ord(s) * 10_000 + 1500)]
    docs = make(rows)
    got = mixing.plan(docs).toPandas()
    for (_, size), g in got[got.target < 2 * got.source_size].groupby(["target", "size"]):
        assert g.copies.nunique() <= 2  # certain copies and at most one more
    short, long = got[got["size"] == 1], got[got["size"] == 8]
    assert short.copies.mean() > long.copies.mean()


def test_query_of_neighbours(spark, sf):
    got = queries.op9_neighbours(spark, sf).toPandas()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids, hit, total = np.stack(rows.embedding.values).astype(float), rows.vec_id.values, 0, 0
    assert sorted(set(got.query_id)) == [i for i in ids if i % 20 == 0]
    for q, g in got.groupby("query_id"):
        score = x @ x[np.searchsorted(ids, q)]
        best = [i for i in ids[np.lexsort([ids, -score])] if i != q][:20]
        hit, total = hit + len(set(best) & set(g.vec_id)), total + 20
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g.score, score[np.searchsorted(ids, g.vec_id)], atol=1e-12)
        assert g.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == g.vec_id.tolist()
    assert hit / total >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[1000:] = codes[rng.integers(0, 20, 2000)] ^ (rng.random((2000, 8)) < 0.4).astype(np.uint8)
    index = neighbours.Index(codes)
    for radius in (0, 3, 7, 8, 20, 64):
        for q in codes[::400]:
            assert index.within(q, radius).tolist() == np.flatnonzero(neighbours.distances(codes, q) <= radius).tolist()


def test_neighbours_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1 + i % 5)], "x") for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], "x") for i in range(60)]  # ties
    rows += [(20, None, "x"), (40, [0.0] * 6, "x"), (60, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (80, [float("nan")] + [0.0] * 5, "x"), (500, [float("inf")] * 6, "x"), (520, [1.0, 2.0], "x"), (None, [1.0] * 6, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, visit string")
    got = neighbours.search(table, block=64, queries=8).toPandas()
    kept = [(i, v) for i, v, _ in rows if i is not None and v is not None and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept])
    hit = total = 0
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        score = (x * x[ids == q][0]).sum(1)
        want = [i for i in ids[np.lexsort([ids, -score])].tolist() if i != q][:20]
        own = got[got.query_id == q].sort_values("rank")
        hit, total = hit + len(set(want) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9 and len(got) == total
    tied = got[got.query_id == 420].sort_values("rank")
    assert tied.vec_id.tolist() == sorted(tied.vec_id[tied.score == tied.score.iloc[0]]) + tied.vec_id[tied.score < tied.score.iloc[0]].tolist()
    assert neighbours.search(table.limit(0)).count() == 0
    few = neighbours.search(table.where("vec_id in (100, 101, 102)"))
    assert few.count() == 2


def test_neighbours_of_repeated_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=6)]) for i in range(200)]
    rows += [rows[20]] * 19 + [rows[40]] + [(60, [float(v) for v in rng.normal(size=6)])]  # 20 and 2 copies; two vectors of one vec_id
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=64, queries=8).toPandas()
    assert got.columns.tolist() == ["query_id", "rank", "vec_id", "score"]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in range(0, 200, 20):
        own = got[got.query_id == q]
        assert own.groupby("rank").size().tolist() == [int((ids == q).sum())] * 20
        want = Counter()
        for v in x[ids == q]:
            score = (x * v).sum(1)
            want.update([(ids[i], round(score[i], 9)) for i in np.lexsort([ids, -score]) if ids[i] != q][:20])
        assert (want & Counter(zip(own.vec_id, own.score.round(9)))).total() >= 0.9 * want.total()
    assert got[got.query_id == 20].vec_id.nunique() >= 19  # the two rows of 40 count each on its own


def test_pipeline_stages(spark, sf):
    docs = queries.documents(spark, sf)
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, left, sf), "t")
        assert after.columns == docs.columns
        if name == "toxicity":
            model = toxicity.fit(docs, queries.labels(spark, sf))
            assert after.count() == toxicity.kept(left, model).count() and after.exceptAll(left).isEmpty()
        elif name == "near_duplicates":
            kept = {r["doc_id"] for r in near.clusters(left).where("kept").collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(kept)
        elif name == "secrets":
            assert after.count() == left.count()
        else:
            assert sum(words(r["text"]) for r in after.collect()) == sum(r["taken"] for r in mixing.plan(left).collect())
        left = after
    assert corpus_pipeline.STAGES[-1][1](spark, left, sf).agg({"length": "sum"}).first()[0] == corpus_pipeline.run(spark, sf).agg({"length": "sum"}).first()[0]


def test_pipeline_of_odd_rows(spark, odd, none, sf):
    """Each stage gives no row that it was not given, the third as many of each id, and the last every token of its input once."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            given = Counter(r.doc_id for r in docs.select("doc_id").collect())
            texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
            out = corpus_pipeline.stored(stage(spark, docs, sf), "t")
            got = Counter(r.doc_id for r in out.select("doc_id").collect())
            assert set(got) <= set(given)
            if name == "packing":
                tokens = Counter()
                for key, text in texts:
                    tokens[key] += len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
                assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
            else:
                assert out.columns == docs.columns
            if name in ("toxicity", "near_duplicates"):
                assert not got - given
            if name == "secrets":
                assert got == given
            docs = out
