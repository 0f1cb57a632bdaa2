"""Personal data: high-recall generators propose overlapping spans, boosted
trees score their format and context, calibrated thresholds select.

DataFrame functions and Spark ML only; the fitted trees are applied as one
column expression, so scoring needs no join and no second row per span."""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brook.llm.common import ready, scratch, spare, text_key
from brook.llm.quality import bind

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Each finds what its plain form finds;
# possessive repeats and starts only where a run of characters starts keep
# them linear in texts without white space.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Generators beyond the base: addresses spelled out, IPv6, card numbers inside
# longer digit runs or of other lengths, numbers without a country code.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++"
             r"(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z])",
}
# What a text must hold before a pattern is worth trying.
# A hint is a part of each way in which either pattern of its kind can match.
HINTS = {"email": r"@|\(at\)|\[at\]| at  ?[A-Za-z0-9-]+ ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]",
         "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20-]?[0-9]",
         "phone": r"\+[0-9]|[0-9][\x20.)-]"}
# Fixed value: words that announce personal data.
CUES = r"(?i)mail|write|contact|phone|tel|call|fax|mobile|card|visa|credit|ccn|\bip\b|host|addr|server"
SPAN = "array<struct<s:int,e:int,m:string>>"

# Labelled spans that the trees are fitted to (about, at most,
# for each label), trees and depth, precision that a threshold must reach, and
# how many true spans it must be seen on.
SAMPLE = 4_000
TREES, DEPTH = 10, 3
PRECISION = 0.95
SEEN = 10


def spans_of(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping: start and end (exclusive) in
    code points, and the matched text."""
    def walk(found: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            at = acc["p"] + F.length(F.get(found["gaps"], i))
            m = F.get(found["ms"], i)
            return F.struct((at + F.length(m)).alias("p"), F.array_append(
                acc["out"], F.struct(at.alias("s"), (at + F.length(m)).alias("e"), m.alias("m"))).alias("out"))

        start = F.struct(F.lit(0).alias("p"), F.expr(f"CAST(array() AS {SPAN})").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found["ms"]) - 1), start, step, lambda acc: acc["out"])

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("ms"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), bind(parts, walk)).otherwise(F.expr(f"CAST(array() AS {SPAN})"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string of 2 to 19 digits passes the Luhn check."""
    def of(d: Column) -> Column:
        one = lambda i: F.substring(d, i, F.lit(1)).cast("int")
        twice = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0),
                            lambda acc, i: acc + F.when(i % 2 == 0, twice(one(i))).otherwise(one(i)))
        return total % 10 == 0

    return F.when(F.length(digits).between(2, 19), bind(F.reverse(digits), of)).otherwise(F.lit(False))


def base_holds(kind: str, m: Column) -> Column:
    """The check that a base match must pass."""
    byte = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return {
        "email": lambda: F.lit(True),
        # Zeros alone are eaten by 0*+, so they are allowed apart.
        "ip": lambda: m.rlike(rf"^(?:0+|{byte})(?:\.(?:0+(?![0-9])|{byte})){{3}}$"),
        "card": lambda: bind(_digits(m), lambda d: F.length(d).between(16, 19) & luhn(d)),
        "phone": lambda: F.length(_digits(m)).between(8, 15),
    }[kind]()


def more_holds(kind: str, m: Column) -> Column:
    """A weak label for a generated span: a rule that holds for nearly all true
    ones and few others.  Labels train the trees; they never select."""
    return {
        "email": lambda: m.rlike(r"(?i)(?:\(at\)|\[at\]| at ).*(?:\.|dot\)? ?|dot\] ?)(?:com|org|net|edu|gov|info|io|[a-z]{2})$")
        & m.rlike(r"\(|\[| dot |\."),
        "ip": lambda: m.rlike("[0-9]"),
        "card": lambda: bind(_digits(m), lambda d: d.rlike("^[3-6]") & luhn(d)),
        "phone": lambda: bind(_digits(m), lambda d: F.length(d).between(9, 12) & d.rlike("^[2-9]")),
    }[kind]()


def features(kind: str, text: Column, x: Column) -> Column:
    """Format and context of a span, as an array of doubles."""
    m, s, e = x["m"], x["s"], x["e"]
    count = lambda p: F.length(m) - F.length(F.regexp_replace(m, p, ""))
    before = F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))
    after = F.substring(text, e + 1, F.lit(12))
    d = _digits(m)
    put = [F.lit(float(kind == k)) for k in KINDS] + [
        F.length(m), count("[0-9]"), count("[A-Za-z]"), count(r"[\x20().:@\[\]-]"),
        F.size(F.array_distinct(F.split(d, ""))), luhn(d).cast("int"), F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)),
        F.length(F.regexp_extract(m, "([0-9]+)$", 1)), before.rlike(r"[0-9]\W?$").cast("int"),
        before.rlike(r"[A-Za-z]$").cast("int"), after.rlike(r"^\W?[0-9]").cast("int"), after.rlike(r"^[A-Za-z]").cast("int"),
        before.rlike(CUES).cast("int"), m.rlike(r"\.[A-Za-z]{2,}$").cast("int"),
        F.length(F.regexp_replace(F.concat(before, after), "[^0-9]", ""))]
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in put])


def candidates(text: Column) -> Column:
    """All proposed spans of a text, base matches and generated ones, as an
    array of (kind, s, e, base, holds, f)."""
    def proposed(k: int, kind: str, base: bool) -> Column:
        holds = base_holds if base else more_holds
        return F.transform(spans_of(text, (BASE if base else MORE)[kind]), lambda x: F.struct(
            F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
            holds(kind, x["m"]).alias("holds"), features(kind, text, x).alias("f")))

    parts = [F.when(text.rlike(HINTS[kind]), F.concat(proposed(k, kind, True), proposed(k, kind, False)))
             for k, kind in enumerate(KINDS)]
    empty = F.expr("CAST(array() AS array<struct<kind:int,s:int,e:int,base:boolean,holds:boolean,f:array<double>>>)")
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def tree_column(description: str, f: Column) -> Column:
    """A fitted regression tree, from its printed form, as nested conditions."""
    lines = iter([x.strip() for x in description.splitlines() if re.search(r"If|Else|Predict", x) and "DecisionTree" not in x])

    def node() -> Column:
        line = next(lines)
        if line.startswith("Predict"):
            return F.lit(float(line.split(":")[1]))
        k, limit = re.fullmatch(r"If \(feature (\d+) <= (.+)\)", line).groups()
        low = node()
        next(lines)  # Else
        return F.when(f[int(k)] <= float(limit), low).otherwise(node())

    return node()


def score(model: GBTClassificationModel, f: Column) -> Column:
    """The model's probability that a span is personal data."""
    total = sum((tree_column(t.toDebugString, f) * float(w) for t, w in zip(model.trees, model.treeWeights, strict=True)),
                F.lit(0.0))
    return 1 / (1 + F.exp(-2 * total))


class Selector:
    """Fitted trees and a threshold for each kind."""

    def __init__(self, model: GBTClassificationModel | None, thresholds: dict[int, float]):
        self.model, self.thresholds = model, thresholds

    def added(self, cands: Column) -> Column:
        """Generated spans that reach their kind's threshold and touch no base
        span that holds; of those that touch each other, the longest stays."""
        none = F.filter(cands, lambda c: F.lit(False))
        if self.model is None or not self.thresholds:
            return none

        def good(c: Column) -> Column:
            limit = F.lit(2.0)
            for k, t in self.thresholds.items():
                limit = F.when(c["kind"] == k, F.lit(t)).otherwise(limit)
            return score(self.model, c["f"]) >= limit

        longer = lambda a, b: ((a["e"] - a["s"]) > (b["e"] - b["s"])) | (
            ((a["e"] - a["s"]) == (b["e"] - b["s"])) & (F.struct(a["kind"], a["s"]) < F.struct(b["kind"], b["s"])))

        def longest(new: Column) -> Column:
            return F.filter(new, lambda c: ~F.exists(new, lambda o: touch(o, c) & longer(o, c)))

        return F.when(F.size(cands) > 0, bind(F.filter(free_spans(cands), good), longest)).otherwise(none)


def base_spans(cands: Column) -> Column:
    return F.filter(cands, lambda c: c["base"] & c["holds"])


def touch(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def free_spans(cands: Column) -> Column:
    """Generated spans that touch no base span that holds."""
    return bind(base_spans(cands), lambda base: F.filter(
        cands, lambda c: ~c["base"] & ~F.exists(base, lambda b: touch(b, c))))


def fit(found: DataFrame, sample: int = SAMPLE) -> Selector:
    """Fit trees and thresholds to proposed spans (``cands`` of ``found``).

    Labels: the base check for base matches, ``more_holds`` for the others.  The
    trees are fitted to about ``sample`` spans of each label at most, chosen by
    hash in equal shares for each kind and origin, so a rare kind is not
    crowded out.  The thresholds are set on all distinct generated spans that
    touch no base span (only those can be added): for each kind the lowest of
    20 scores from which they are true with the precision asked for, on enough
    true spans.  A kind without one, or a corpus without both labels, adds
    nothing."""
    def flat(cands: Column) -> DataFrame:
        return found.select("text_hash", F.explode(cands).alias("c")).select("text_hash", "c.*").withColumn(
            "order", F.xxhash64("text_hash", "kind", "s", "e", "base"))

    # Distinct spans, or thousands of copies of a text would fill the sample.
    spans, layer = flat(F.col("cands")), ["kind", "base", "holds"]
    sizes = spans.groupBy(*layer).agg(F.approx_count_distinct("order").alias("n")).collect()  # at most 16 rows
    share = F.lit(0.0)
    for r in sizes:
        here = (F.col("kind") == r["kind"]) & (F.col("base") == r["base"]) & (F.col("holds") == r["holds"])
        share = F.when(here, F.lit(sample / (2 * len(KINDS) * r["n"]))).otherwise(share)
    rows = scratch(spans.where(F.shiftrightunsigned("order", 11) / F.lit(float(1 << 53)) < share).dropDuplicates(["order"])
                   .select("f", F.col("holds").cast("double").alias("label")), "pii-sample")
    train = rows.withColumn("features", array_to_vector("f"))
    if train.select("label").distinct().count() < 2:
        return Selector(None, {})
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7).fit(train.select("features", "label").coalesce(1))
    scored = flat(free_spans(F.col("cands"))).select(
        "kind", "order", F.floor(score(model, F.col("f")) * 20).cast("int").alias("bin"), F.col("holds").cast("double").alias("label"))
    bins = (scored.dropDuplicates(["kind", "order"]).groupBy("kind", "bin")
            .agg(F.sum("label").alias("true"), F.count("*").alias("all")).collect())  # 4 x 21 rows
    thresholds: dict[int, float] = {}
    for k in range(len(KINDS)):
        right = n = 0.0
        for r in sorted((r for r in bins if r["kind"] == k), key=lambda r: -r["bin"]):
            right, n = right + r["true"], n + r["all"]
            if right >= SEEN and right >= PRECISION * n:
                thresholds[k] = r["bin"] / 20
    return Selector(model, thresholds)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``doc, text_hash, base, added`` of every row of ``docs``: arrays of
    (kind, s, e), kinds numbered as in ``KINDS``, sorted by kind and start,
    places in code points, ends exclusive.  ``base``: matches of the base
    patterns that pass their check.  ``added``: generated spans that the trees
    select; they touch no base span.

    Null and empty texts hold no spans.  Texts are searched whole and read
    once; the spans are written, and the model is fitted to a bounded sample of
    them.  Repeated rows have the same spans; null ids are carried through;
    other columns are not read.  An empty table gives an empty result."""
    ready(docs)
    body = F.coalesce(F.col(text_col), F.lit(""))
    found = scratch(docs.select(F.col(id_col).cast("long").alias("doc"), text_key(text_col).alias("text_hash"),
                                bind(body, candidates).alias("cands")), "pii-spans")
    selector = fit(found, sample)
    bare = lambda x: F.array_sort(F.transform(x, lambda c: F.struct(
        c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"))))
    return found.select("doc", "text_hash", bare(base_spans(F.col("cands"))).alias("base"),
                        bare(selector.added(F.col("cands"))).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with every span that ``find`` returns replaced by its kind in
    angle brackets (``<EMAIL>``), and ``n_redacted`` (int, replacing a column of that
    name).  Where spans
    overlap, what is left of the later one is replaced as well.  Null texts
    stay null; other columns are carried through unread.

    The trees are fitted to the spans of the whole input first; then each row
    is searched again and cut in place, so no text is shuffled."""
    ready(docs)
    body = F.coalesce(F.col(text_col), F.lit(""))
    # The search that fits the trees keeps only texts that have a span.
    found = scratch(docs.select(text_key(text_col).alias("text_hash"), bind(body, candidates).alias("cands"))
                    .where(F.size("cands") > 0), "pii-spans")
    selector = fit(found, sample)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cut(found_: Column) -> Column:
        text, spans = found_["t"], found_["spans"]

        def step(acc: Column, x: Column) -> Column:
            begins = F.greatest(x["s"], acc["p"])
            piece = F.concat(F.substring(text, acc["p"] + 1, begins - acc["p"]), F.get(names, x["kind"]))
            return F.when(x["e"] > acc["p"], F.struct(x["e"].alias("p"), F.concat(acc["out"], piece).alias("out"))).otherwise(acc)

        start = F.struct(F.lit(0).alias("p"), F.lit("").alias("out"))
        return F.aggregate(spans, start, step,
                           lambda acc: F.concat(acc["out"], F.substring(text, acc["p"] + 1, F.length(text))))

    def by_place(cands: Column) -> Column:
        chosen = F.concat(base_spans(cands), selector.added(cands))
        return F.array_sort(F.transform(chosen, lambda c: F.struct(
            c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))

    spans = bind(bind(body, candidates), by_place)
    out = bind(F.struct(body.alias("t"), spans.alias("spans")), lambda x: F.struct(
        F.size(x["spans"]).alias("n"), F.when(F.size(x["spans"]) > 0, cut(x)).alias("t")))
    (got,) = spare(docs, "_redacted")
    return docs.withColumn(got, out).withColumns(
        {text_col: F.coalesce(F.col(f"{got}.t"), F.col(text_col)), "n_redacted": F.col(f"{got}.n")}).drop(got)
