"""Training-set preparation for the text classifier, on Spark instead of one
machine per rank: select, label ids, fixed-length token ids, rank shards,
batches, and a Spark ML classifier."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.operators.ordering import global_index
from brook.operators.sequence import row_number_within

# The trainer's parameter names and defaults.
TEXT_COLUMN = "title"
LABEL_COLUMN = "source"
NUM_LABELS = 0
EPOCHS = 3
BATCH_SIZE = 8
LR = 0.5
MAX_LENGTH = 128
VOCAB_SIZE = 30522
PAD_ID = 0
# Fixed value: coefficients of a classifier (32 MB of doubles; the driver and each task hold some copies).
MAX_COEFFICIENTS = 1 << 22

# Fixed value: rows of a training step in one file.
STEP_ROWS = 4_096


def train_frame(df: DataFrame, text_col: str = TEXT_COLUMN, label_col: str = LABEL_COLUMN,
                keep=()) -> DataFrame:
    """``_text`` / ``_label_name`` as strings; rows with either NULL dropped."""
    for c in (text_col, label_col):
        if c not in df.columns:
            raise ValueError(f"column {c!r} not in {df.columns}")
    out = df.select(*keep, F.col(text_col).cast("string").alias("_text"),
                    F.col(label_col).cast("string").alias("_label_name"))
    return out.dropna(subset=["_text", "_label_name"])


def label_map(frame: DataFrame) -> DataFrame:
    """Sorted distinct labels -> dense ids 0..k-1 (label, id)."""
    labels = frame.select(F.col("_label_name").alias("label")).distinct()
    return global_index(labels, ["label"], pos_col="id").select("label", "id")


def n_classes(lmap: DataFrame, override: int = NUM_LABELS) -> int:
    return override if override else lmap.count()


def encode(frame: DataFrame, lmap: DataFrame | None = None) -> DataFrame:
    """Attach the integer label.  The map is one row per label: AQE broadcasts
    it once it has measured it small, and else splits a hot label's rows."""
    lmap = lmap if lmap is not None else label_map(frame)
    m = lmap.select(F.col("label").alias("_label_name"), F.col("id").cast("int").alias("_label"))
    return frame.join(m, "_label_name")


def train_profile(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("_label").alias("n_classes"))


def tokens(df: DataFrame, text_col: str = "_text", max_length: int = MAX_LENGTH,
           vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """Whitespace words of the whole text -> hashed ids in [1, vocab_size),
    truncated / padded to ``max_length`` with an attention mask.  ``n_words``
    counts every word of the text."""
    words = F.split(F.trim(F.col(text_col)), r"\s+")
    words = F.when(F.trim(F.col(text_col)) == "", F.array().cast("array<string>")).otherwise(words)
    # The first 32 bits of a word's md5 choose its id: any engine can repeat it.
    # Sizes are those of the words: hashes would else be worked out once more for each.
    first = F.slice(words, 1, max_length)
    kept = F.transform(first, lambda w: (
        F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % (vocab_size - 1) + 1).cast("int"))
    pad = F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(max_length) - F.size(first)))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(first)), F.array_repeat(F.lit(0), F.size(pad)))
    return df.withColumns({"n_words": F.size(words), "input_ids": F.concat(kept, pad),
                           "attention_mask": mask})


def shard_order_key(id_col: str, seed: int, epoch) -> Column:
    """The shuffle of one epoch: a hash of (seed + epoch, id)."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return F.md5(F.concat((F.lit(seed) + e).cast("string"), F.lit(":"), F.col(id_col).cast("string")))


def shard_epochs(df: DataFrame, id_col: str, world_size: int, seed: int = 42, epochs=(0,)) -> DataFrame:
    """Assign every row a rank for each epoch: shuffled position ``i`` ->
    rank ``i % world_size``.  The first rows are repeated at the end until the
    count divides by the world size, so every rank gets the same number.

    All epochs are numbered in one pass: positions come from the segmented
    row number per epoch (one range shuffle for every epoch; an epoch is a
    hot key spread over many partitions, never one task)."""
    e = df.select("*", F.explode(F.array(*[F.lit(int(x)) for x in epochs])).alias("epoch"))
    keyed = e.withColumn("_key", shard_order_key(id_col, seed, F.col("epoch")))
    numbered = row_number_within(keyed, "epoch", ["_key", id_col], "_rn").withColumn("pos", F.col("_rn") - 1)
    totals = numbered.groupBy("epoch").agg(F.max("_rn").alias("_n"))  # one row per epoch
    idx = numbered.join(F.broadcast(totals), "epoch")
    pad = (F.lit(world_size) - F.col("_n") % world_size) % world_size
    extra = idx.filter(F.col("pos") < pad).withColumn("pos", F.col("pos") + F.col("_n"))
    out = idx.unionByName(extra)
    return out.withColumns({"rank": (F.col("pos") % world_size).cast("int"),
                            "shard_pos": F.floor(F.col("pos") / world_size)}).drop("_key", "_n", "_rn")


def shard(df: DataFrame, id_col: str, world_size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    return shard_epochs(df, id_col, world_size, seed, (epoch,))


def batches(sharded: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Batch number inside a rank's shard."""
    return sharded.withColumn("batch", F.floor(F.col("shard_pos") / batch_size))


def write_label_map(lmap: DataFrame, path: str) -> None:
    """Persist ``label -> id`` as JSON lines (one small file)."""
    lmap.coalesce(1).write.mode("overwrite").json(path)


def save_classifier(model, lmap: DataFrame, path: str) -> None:
    """Save the fitted pipeline and its label map next to each other."""
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    write_label_map(lmap, f"{path.rstrip('/')}/label_map")


def check_classes(n: int, num_features: int) -> int:
    """The number of classes, if the model's coefficients (features x classes
    doubles, held by the driver) stay within ``MAX_COEFFICIENTS``."""
    if n * num_features > MAX_COEFFICIENTS:
        raise ValueError(f"{n} classes x {num_features} features exceed {MAX_COEFFICIENTS} coefficients: use fewer features")
    return n


def fit_classifier(frame: DataFrame, passes: int = EPOCHS, reg: float = 0.0, num_features: int = 1 << 16):
    """Tokenizer -> HashingTF -> IDF -> multinomial LogisticRegression on
    ``_text`` / ``_label``; returns the fitted model and the loss per pass."""
    check_classes((frame.agg(F.max("_label")).first()[0] or 0) + 1, num_features)
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=passes, regParam=reg,
                           family="multinomial"),
    ])
    model = pipe.fit(frame)
    history = list(model.stages[-1].summary.objectiveHistory)
    return model, history


# ------------------------------------------------- training in mini-batches
class StepModel(NamedTuple):
    """A softmax classifier over token ids: the weights of a text are the mean
    of its tokens' rows."""
    weights: np.ndarray  # token ids x classes

    def scores(self, ids: np.ndarray) -> np.ndarray:
        used = (ids != PAD_ID)[:, :, None]
        return (self.weights[ids] * used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def _logits(weights: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities and the share that each token has in its text."""
    used = ids != PAD_ID
    share = used / np.maximum(used.sum(axis=1, keepdims=True), 1)
    z = np.einsum("nl,nlc->nc", share, weights[ids])
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), share


def step_gradient(weights: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What some rows add to a step: token ids, a gradient row for each, and
    the summed loss."""
    logs, share = _logits(weights, ids)
    off = np.exp(logs)
    off[np.arange(len(labels)), labels] -= 1
    row, place = np.nonzero(share)
    tokens_, at = np.unique(ids[row, place], return_inverse=True)
    gradient = np.zeros((len(tokens_), weights.shape[1]))
    np.add.at(gradient, at, off[row] * share[row, place][:, None])
    return tokens_, gradient, float(-logs[np.arange(len(labels)), labels].sum())


def _matrix(column, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def fit_steps(encoded: DataFrame, id_col: str = "id", world_size: int = 4, batch_size: int = BATCH_SIZE, lr: float = LR,
              epochs: int = EPOCHS, num_labels: int = NUM_LABELS, max_length: int = MAX_LENGTH, vocab_size: int = VOCAB_SIZE,
              seed: int = 42) -> tuple[StepModel, list[float]]:
    """Synchronous mini-batch descent over rank shards: ``_text`` / ``_label``
    -> the model and the mean loss of each pass.

    Each pass deals the rows anew (``shard_epochs``, padded); step ``k`` takes
    batch ``k`` of every rank, and all ranks take one step of ``lr`` together
    along the mean gradient of its rows.  A step is one Spark job: tasks add up
    the gradients of their rows by token, Spark sums them over tasks, and the
    driver, which holds the weights (``MAX_COEFFICIENTS`` bounds them), gets one
    row per token of the step.  Steps follow each other, so their number is
    what a pass costs: the batch size has to grow with the rows.  The rows of a
    pass are written once, in a folder a step, and a step reads its own: of
    about ``STEP_ROWS`` rows a file, so as many tasks as there are share it."""
    from brook.session import scratch_path

    spark = encoded.sparkSession
    classes = num_labels or (encoded.agg(F.max("_label")).first()[0] or 0) + 1
    weights = np.zeros((vocab_size, check_classes(classes, vocab_size)))
    rows = tokens(encoded, max_length=max_length, vocab_size=vocab_size).select(id_col, F.col("_label").cast("int").alias("label"), "input_ids")
    # Dealing samples and numbers its rows in jobs of their own: texts are read and hashed once, before.
    path = scratch_path(spark, "training-rows")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    path = scratch_path(spark, "training-steps")
    dealt = batches(shard_epochs(rows, id_col, world_size, seed, range(epochs)), batch_size)
    files = -(-batch_size * world_size // STEP_ROWS)
    (dealt.select("epoch", F.col("batch").cast("int").alias("step"), "label", "input_ids").repartition(files)
          .write.partitionBy("epoch", "step").parquet(path))
    dealt = spark.read.schema("epoch int, step int, label int, input_ids array<int>").parquet(path)
    steps = {r["epoch"]: r["n"] for r in dealt.groupBy("epoch").agg((F.max("step") + 1).alias("n")).collect()}
    history = []

    def gradients(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = weights
        for b in batches_:
            if b.num_rows:
                ids, gradient, loss = step_gradient(now, _matrix(b.column("input_ids"), max_length), b.column("label").to_numpy())
                # Token -1 carries the loss and the rows.
                extra = np.zeros((1, now.shape[1] + 2))
                extra[0, -2:] = loss, b.num_rows
                whole = np.vstack([np.hstack([gradient, np.zeros((len(ids), 2))]), extra])
                at = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * whole.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1), pa.int32()), pa.ListArray.from_arrays(at, pa.array(whole.ravel()))],
                                                 ["token", "g"])

    for epoch in range(epochs):
        lost = count = 0.0
        for k in range(steps.get(epoch, 0)):
            part = dealt.filter((F.col("epoch") == epoch) & (F.col("step") == k)).mapInArrow(gradients, "token int, g array<double>")
            columns = [F.sum(F.get("g", i)).alias(f"g{i}") for i in range(classes + 2)]
            got = part.groupBy("token").agg(*columns).toArrow()
            token = got.column("token").to_numpy()
            sums = np.stack([got.column(f"g{i}").to_numpy() for i in range(classes + 2)], axis=1)
            loss, n = sums[token == -1][0, -2:]
            weights = weights.copy()
            weights[token[token >= 0]] -= lr / n * sums[token >= 0][:, :classes]
            lost, count = lost + loss, count + n
        history.append(lost / max(count, 1.0))
    return StepModel(weights), history


def predict_steps(model: StepModel, encoded: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``encoded`` with ``prediction``, the class of the highest score."""
    rows = tokens(encoded, max_length=max_length, vocab_size=model.weights.shape[0]).drop("n_words", "attention_mask")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            ids = _matrix(b.column("input_ids"), max_length) if b.num_rows else np.zeros((0, max_length), np.int32)
            best = model.scores(ids).argmax(axis=1) if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best.astype(np.int32))], [*b.schema.names, "prediction"])

    from pyspark.sql.types import IntegerType, StructField, StructType
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("prediction", IntegerType())])).drop("input_ids")
