import pytest
from pyspark.sql import functions as F

from brook.operators import trainprep as T
from brook.operators.ordering import global_index
from paths import SF001


def test_global_index_dense(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    got = global_index(df, ["k"], num_partitions=7).select("k", "_pos").collect()
    assert sorted((r.k, r._pos) for r in got) == [(i, i) for i in range(1000)]


def test_label_map_sorted_dense(spark):
    df = spark.createDataFrame([("a", "z"), ("b", "b"), ("c", None), (None, "a"), ("d", "b")], "title string, source string")
    frame = T.train_frame(df)
    m = sorted((r.label, r.id) for r in T.label_map(frame).collect())
    assert m == [("b", 0), ("z", 1)]
    enc = {r._text: r._label for r in T.encode(frame).collect()}
    assert enc == {"a": 1, "b": 0, "d": 0}


def test_tokens_fixed_length(spark):
    df = spark.createDataFrame([("one two  three",), ("",), (" ".join(["w"] * 300),)], "_text string")
    rows = T.tokens(df, max_length=128).collect()
    assert [r.n_words for r in rows] == [3, 0, 300]
    assert all(len(r.input_ids) == 128 and len(r.attention_mask) == 128 for r in rows)
    assert [sum(r.attention_mask) for r in rows] == [3, 0, 128]
    assert rows[0].input_ids[3:] == [0] * 125 and all(0 < i < T.VOCAB_SIZE for i in rows[0].input_ids[:3])


def test_token_ids_follow_the_md5_of_the_word(spark):
    import hashlib

    got = T.tokens(spark.createDataFrame([("a b a",)], "_text string"), max_length=4).first().input_ids
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (T.VOCAB_SIZE - 1) + 1 for w in "aba"]
    assert got == [*want, T.PAD_ID]


def test_too_many_classes_are_refused(spark):
    df = spark.createDataFrame([("a", 5000)], "_text string, _label int")
    with pytest.raises(ValueError):
        T.fit_classifier(df, num_features=1 << 18)


def test_shards_equal_and_padded(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "doc_id")
    s = T.batches(T.shard(df, "doc_id", world_size=4, seed=1, epoch=0), batch_size=8)
    sizes = {r.rank: r.n for r in s.groupBy("rank").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 26, 1: 26, 2: 26, 3: 26}
    assert s.select("doc_id").distinct().count() == 103
    other = {r.doc_id: r.rank for r in T.shard(df, "doc_id", 4, seed=1, epoch=1).collect()}
    first = {r.doc_id: r.rank for r in s.collect()}
    assert first != other  # a new epoch reshuffles


def test_classifier_loss_falls_and_saves(spark, tmp_dir):
    from pyspark.ml import PipelineModel

    d = spark.read.parquet(f"{SF001}/documents.parquet")
    frame = T.train_frame(d, "text", "lang")
    lmap = T.label_map(frame)
    enc = T.encode(frame, lmap)
    model, hist = T.fit_classifier(enc, passes=3, num_features=1 << 12)
    assert len(hist) >= 2 and hist[-1] < hist[0]
    T.save_classifier(model, lmap, f"{tmp_dir}/clf")
    back = PipelineModel.load(f"{tmp_dir}/clf/model")
    assert back.transform(enc).count() == enc.count()
    assert spark.read.json(f"{tmp_dir}/clf/label_map").count() == lmap.count()


def test_steps_equal_a_plain_run(spark):
    """Loss per pass and weights are those of one machine that takes the same batches."""
    import numpy as np

    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    rows = [(i, " ".join(words[(i * 7 + k * (i % 3 + 1)) % 6] for k in range(i % 5)), i % 3) for i in range(50)]
    enc = spark.createDataFrame(rows, "id long, _text string, _label int")
    kw = dict(world_size=3, batch_size=4, lr=0.7, epochs=2, max_length=6, vocab_size=40)
    model, loss = T.fit_steps(enc, "id", **kw, num_labels=4)
    ids = {r["id"]: r["input_ids"] for r in T.tokens(enc, max_length=6, vocab_size=40).collect()}
    dealt = T.batches(T.shard_epochs(enc.select("id"), "id", 3, 42, range(2)), 4).collect()
    w, want = np.zeros((40, 4)), []
    for epoch in range(2):
        total = n = 0
        for step in range(max(r["batch"] for r in dealt if r["epoch"] == epoch) + 1):
            batch = [r["id"] for r in dealt if r["epoch"] == epoch and r["batch"] == step]
            grad = np.zeros_like(w)
            for i in batch:
                used = [t for t in ids[i] if t]
                x = np.zeros(40)
                for t in used:
                    x[t] += 1 / len(used)
                z = x @ w
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                total -= np.log(p[i % 3])
                p[i % 3] -= 1
                grad += np.outer(x, p)
            n += len(batch)
            w -= 0.7 / len(batch) * grad
        want.append(total / n)
    assert np.allclose(loss, want) and np.allclose(model.weights, w) and loss[1] < loss[0]
    predicted = {r["id"]: r["prediction"] for r in T.predict_steps(model, enc, 6).collect()}
    assert len(predicted) == 50 and predicted[1] == int(np.argmax(model.scores(np.array([ids[1]]))[0]))


def test_rows_of_a_step_are_shared_by_tasks(spark, monkeypatch):
    """A step of many rows is read from several files, and the texts are hashed into ids once, before they are dealt."""
    from brook.session import scratch_path

    paths, made = [], []
    monkeypatch.setattr("brook.session.scratch_path", lambda *a: paths.append(scratch_path(*a)) or paths[-1])
    monkeypatch.setattr(T, "STEP_ROWS", 50)
    plain = T.tokens
    monkeypatch.setattr(T, "tokens", lambda *a, **k: made.append(1) or plain(*a, **k))
    frame = spark.range(400).selectExpr("id", "concat('w', id % 2, ' x', id) AS _text", "CAST(id % 2 AS int) AS _label")
    model, loss = T.fit_steps(frame, "id", 2, 100, lr=4.0, epochs=2)
    assert len(made) == 1 and loss[1] < loss[0]
    steps = spark.read.parquet(paths[-1])
    assert sorted((r.epoch, r.step, r["count"]) for r in steps.groupBy("epoch", "step").count().collect()) == [(e, s, 200) for e in (0, 1) for s in (0, 1)]
    assert steps.filter("epoch = 0 AND step = 1").select(F.input_file_name()).distinct().count() == 4
    assert len(paths) == 2  # ids, and the steps dealt from them
