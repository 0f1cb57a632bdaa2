"""Training-data preparation queries (articles / documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from brook.operators import clean as C
from brook.operators import trainprep as T
from brook.plans import views as V
from brook.plans.catalog import register
from brook.plans.oracle_views import with_views

WORLD_SIZE = 4
SEED = 42
EPOCH_LIST = (0, 1, 2)

_GOOD = """(SELECT id, lower(trim(source)) AS source, trim(title) AS title FROM articles
  WHERE title IS NOT NULL AND true_date IS NOT NULL)"""


def _frame(spark, sf):
    good, _ = C.split(C.clean(V.articles(spark, sf), lineage=False))
    return T.train_frame(good, keep=["id"])


@register("label_map", with_views(f"""
  SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS BIGINT) AS id
  FROM (SELECT DISTINCT source AS label FROM {_GOOD})""", "articles"))
def label_map(spark, sf):
    return T.label_map(_frame(spark, sf))


@register("label_encode", with_views(f"""
  SELECT g.id, md5(g.title) AS text_md5, CAST(m.id AS INTEGER) AS _label
  FROM {_GOOD} g JOIN (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS id
                       FROM (SELECT DISTINCT source AS label FROM {_GOOD})) m ON g.source = m.label""", "articles"))
def label_encode(spark, sf):
    e = T.encode(_frame(spark, sf))
    return e.select("id", F.md5("_text").alias("text_md5"), "_label")


@register("train_profile", with_views(f"""
  SELECT count(*) AS n_rows, count(DISTINCT source) AS n_classes FROM {_GOOD}""", "articles"))
def train_profile(spark, sf):
    return T.train_profile(T.encode(_frame(spark, sf)))


@register("fixed_length_tokens", """
  WITH w AS (
    SELECT doc_id, CASE WHEN trim(text) = '' THEN [] ELSE regexp_split_to_array(trim(text), '\\s+') END AS ws FROM documents),
  t AS (
    SELECT doc_id, len(ws) AS n_words,
      list_transform(ws[1:128], lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % 30521 + 1) AS ids FROM w)
  SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, 128 AS n_ids, CAST(least(n_words, 128) AS BIGINT) AS mask_sum,
    md5(array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda i: 0)), ',')) AS ids_md5
  FROM t""")
def fixed_length_tokens(spark, sf):
    d = V.table(spark, sf, "documents")
    t = T.tokens(d, text_col="text")
    return t.select("doc_id", "n_words", F.size("input_ids").alias("n_ids"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


def _sharded(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id")
    return T.shard_epochs(d, "doc_id", WORLD_SIZE, SEED, EPOCH_LIST)


_SHARD_SQL = f"""
  WITH o AS (
    SELECT e.epoch, doc_id, count(*) OVER (PARTITION BY e.epoch) AS n,
      row_number() OVER (PARTITION BY e.epoch ORDER BY md5(CAST({SEED} + e.epoch AS VARCHAR) || ':' ||
        CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos
    FROM documents, (SELECT unnest({list(EPOCH_LIST)}) AS epoch) e),
  p AS (SELECT epoch, doc_id, pos FROM o
        UNION ALL SELECT epoch, doc_id, pos + n FROM o WHERE pos < ({WORLD_SIZE} - n % {WORLD_SIZE}) % {WORLD_SIZE})"""


@register("shard_assign", _SHARD_SQL + f"""
  SELECT CAST(epoch AS INTEGER) AS epoch, CAST(pos % {WORLD_SIZE} AS INTEGER) AS rank,
    count(*) AS n_rows, CAST(sum(doc_id) AS BIGINT) AS sum_ids, CAST(sum(pos) AS BIGINT) AS sum_pos
  FROM p GROUP BY 1, 2""")
def shard_assign(spark, sf):
    s = _sharded(spark, sf)
    return s.groupBy("epoch", "rank").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.sum("doc_id").cast("bigint").alias("sum_ids"),
                                          F.sum("pos").cast("bigint").alias("sum_pos"))


@register("batches", _SHARD_SQL + f"""
  SELECT CAST(epoch AS INTEGER) AS epoch, CAST(pos % {WORLD_SIZE} AS INTEGER) AS rank,
    CAST(floor(floor(pos / {WORLD_SIZE}) / {T.BATCH_SIZE}) AS BIGINT) AS batch, count(*) AS n_rows,
    CAST(sum(doc_id) AS BIGINT) AS sum_ids
  FROM p GROUP BY 1, 2, 3""")
def batches(spark, sf):
    b = T.batches(_sharded(spark, sf), T.BATCH_SIZE)
    return b.groupBy("epoch", "rank", F.col("batch").cast("bigint").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("doc_id").cast("bigint").alias("sum_ids"))


# A model that has learnt nothing names the largest class for every row.
_LEARNT = with_views(f"""
  SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS _label, count(*) AS n_rows, true AS loss_falls, true AS beats_largest
  FROM {_GOOD} GROUP BY source""", "articles")


def _learnt(predicted, loss, share: float):
    """Rows per class, whether the loss fell from each pass to the next, and
    whether the share of right predictions is above that of the largest class."""
    hits = predicted.groupBy("_label").agg(F.count("prediction").alias("n_rows"), F.count_if(F.col("prediction") == F.col("_label")).alias("hits")).collect()
    n = sum(r["n_rows"] for r in hits)
    beats = sum(r["hits"] for r in hits) / n > max(share, max(r["n_rows"] for r in hits) / n)
    falls = all(b < a for a, b in zip(loss, loss[1:], strict=False))
    spark = predicted.sparkSession
    return spark.createDataFrame([(r["_label"], r["n_rows"], falls, bool(beats)) for r in hits],
                                 "_label int, n_rows long, loss_falls boolean, beats_largest boolean")


@register("text_classifier", _LEARNT)
def text_classifier(spark, sf):
    """Fit title -> source on the good articles and predict them."""
    enc = T.encode(_frame(spark, sf))
    model, loss = T.fit_classifier(enc, passes=T.EPOCHS, num_features=1 << 14)
    return _learnt(model.transform(enc), loss, 0.1)


@register("text_classifier_steps", _LEARNT)
def text_classifier_steps(spark, sf):
    """The same by synchronous mini-batches over four rank shards; the batch
    is an eighth of a shard, so a pass is eight steps at any size."""
    enc = T.encode(_frame(spark, sf))
    batch = max(T.BATCH_SIZE, -(-enc.count() // (8 * WORLD_SIZE)))
    model, loss = T.fit_steps(enc, "id", WORLD_SIZE, batch, lr=4.0)
    return _learnt(T.predict_steps(model, enc), loss, 0.0)
