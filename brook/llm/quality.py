"""Quality rules with host verdicts: per-document rules, failures added up by
host, rates shrunk with an empirical beta prior, verdicts joined back.

DataFrame functions only; texts never leave the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm.common import SPACE_CLASS, id_key, scratch, spare, text_key

# Characters that separate words, and those that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Words per window of the repetition rule, and the base limits.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# A host is not trusted if its odds of failure are so many times
# those of the corpus, so many posterior deviations down.
ODDS = 2.0
DEVIATIONS = 3.0


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body
    uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text: what lies between ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the text holds
    twice or more (all its places count, the first included)."""
    def starts(pairs: Column) -> Column:
        same = lambda x, i: (F.get(pairs, i)["h"] == x["h"])
        again = F.filter(pairs, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False))
                         | F.coalesce(same(x, i + 1), F.lit(False)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        first = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        total = F.aggregate(bind(pairs, starts), first,
                            lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"),
                                                    p.alias("last")), lambda acc: acc["n"])
        # Most texts repeat nothing: they skip the sort.
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0))

    def of(word_hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(word_hashes) - F.lit(window - 1)),
                              lambda i: F.xxhash64(F.slice(word_hashes, i, window)))
        return F.when(F.size(word_hashes) > window, bind(windows, covered)).otherwise(F.lit(0))

    return bind(F.transform(ws, lambda w: F.xxhash64(w)), of).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts that the rules read, over the whole text."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = bind(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return F.struct(
        of_words.alias("of_words"), of_lines.alias("of_lines"),
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``doc, text_hash, host``, the counts, and
    the rules that failed.  ``base_failed``: under 20 words, or over 30 percent
    of the words in repeated windows.  Soft rules, after published heuristics
    for web text: over one symbol in ten words, over 30 percent repeated lines,
    a mean word length outside 3 to 10."""
    m = docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                    F.col(host_col).cast("string").alias("host"), measures(F.col(text_col)).alias("m"))
    rows = m.select("doc", "text_hash", "host", F.col("m.of_words.n").alias("n_words"), "m.word_chars", "m.n_symbols",
                    F.col("m.of_lines.d").alias("n_dup_lines"), F.col("m.of_words.r").alias("n_repeat_words"),
                    F.col("m.of_lines.n").alias("n_lines"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = ((10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
            | (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words")))
    return rows.withColumns({"base_failed": base, "rule_failed": base | soft}).drop("n_lines")


def host_verdicts(rules: DataFrame, odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """``host, n_docs, n_failed, rate, least, host_ok`` of every host that is
    not null.

    The beta prior is fitted to all hosts by moments: mean rate m, variance of
    the rates less their mean binomial noise, strength k = m(1-m)/variance - 1
    held between 1 and 1,000,000.  ``rate`` is the posterior mean
    (m k + failed) / (k + docs): a host with few documents stays close to the
    mean, a large one keeps its own rate.  ``least`` lies ``deviations``
    posterior standard deviations below it.  A host is not trusted if even at
    ``least`` its odds of failure are more than ``odds`` times those of the
    corpus (all failures over all documents of hosts): the limit moves with the
    corpus, and where hosts do not differ all are trusted.  Three numbers reach
    the driver."""
    hosts = scratch(rules.where("host IS NOT NULL").groupBy("host")
                    .agg(F.count("*").alias("n_docs"), F.sum(F.col("rule_failed").cast("long")).alias("n_failed")),
                    "quality-hosts")
    r = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.avg(r).alias("m"), F.var_pop(r).alias("v"), F.avg(1 / F.col("n_docs")).alias("noise"),
                  (F.sum("n_failed") / F.sum("n_docs")).alias("c")).first()
    m, v = s["m"] or 0.0, (s["v"] or 0.0) - (s["m"] or 0.0) * (1 - (s["m"] or 0.0)) * (s["noise"] or 0.0)
    k, c = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6, s["c"] or 0.0
    out = hosts.withColumn("rate", (F.lit(m * k) + F.col("n_failed")) / (F.lit(k) + F.col("n_docs")))
    out = out.withColumn("least", F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.lit(k) + F.col("n_docs") + 1)))
    return out.withColumn("host_ok", ~(F.col("least") * (1 - c) > odds * c * (1 - F.col("least"))))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of ``document_rules`` with ``rate``, ``host_ok`` and ``kept``.

    ``kept`` is false if a base rule failed, or if any rule failed and the
    host is not trusted (``host_verdicts``): on a trusted host a soft
    failure is forgiven, on a bad host it is not, and a document that breaks
    no rule stays wherever it comes from.

    Null and empty texts have no words and are not kept.  Documents without a
    host are judged like those of a trusted one.  Repeated rows are judged row
    by row and count row by row; null ids are carried through; only the three
    named columns are read, so other columns cannot clash.  An empty table
    gives an empty result."""
    rules = scratch(document_rules(docs, id_col, text_col, host_col), "quality-rules")
    hosts = host_verdicts(rules, odds, deviations).select("host", "rate", "host_ok")
    ok = F.coalesce("host_ok", F.lit(True))
    return (rules.join(hosts, "host", "left").withColumn("host_ok", ok)
            .withColumn("kept", ~F.col("base_failed") & (F.col("host_ok") | ~F.col("rule_failed"))))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  odds: float = ODDS, deviations: float = DEVIATIONS) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, all columns."""
    verdicts = quality_verdicts(docs, id_col, text_col, host_col, odds, deviations)
    doc, text, host = spare(docs, "_doc", "_text", "_host")
    # A text under one id may come from two hosts: the host is part of the key.
    kept = verdicts.where("kept").select(id_key("doc").alias(doc), F.col("text_hash").alias(text), F.col("host").alias(host))
    keyed = docs.withColumns({doc: id_key(id_col), text: text_key(text_col), host: F.col(host_col).cast("string")})
    on = (keyed[doc] == kept[doc]) & (keyed[text] == kept[text]) & keyed[host].eqNullSafe(kept[host])
    return keyed.join(kept, on, "left_semi").drop(doc, text, host)
