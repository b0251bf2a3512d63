"""Mixing of sources to target shares of tokens.

A classifier fitted on the labelled texts gives every text its posterior over sources; a text whose source is known
belongs to that source. Projected-gradient least squares then fits nonnegative rates at which texts are drawn, so that
the expected token totals of the sources meet their targets and no rate exceeds its cap. Every gradient needs one
aggregate of as many sums as there are sources, taken over membership classes (texts with the same membership and cap
have the same rate), so the texts themselves are read once. Rates become whole repeats by systematic
rounding along a hash order, by running totals in two levels.
"""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.common import blanks, cut, lookup
from kelpie.llm.encode import TOKENIZERS, token_counts

FEATURES = 1 << 14
_BUCKETS = 1024
MAX_SOURCES = 1000
_UNITS = 100  # posteriors of texts without a source are whole hundredths, so that many share a class


def _named(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lower(blanks(F.coalesce("source", F.lit("")))).alias("source"))


def _hot(sources: list[str]):
    return F.array(*[(F.col("source") == s).cast("double") for s in sources])


def posteriors(labelled: DataFrame, texts: DataFrame, sources: list[str]) -> DataFrame:
    """doc_id, member (array of shares by source, adding to 1) of each row of ``texts`` by naive Bayes over hashed words.

    Fitted on all rows of ``labelled`` (text, source), whose sources lie in ``sources``; with texts of one source only
    that source is certain, and without any all are equally likely. Shares are whole hundredths by largest remainders.
    """
    k = len(sources)
    seen = [r.source for r in labelled.select("source").distinct().orderBy("source").collect()]  # at most MAX_SOURCES
    if len(seen) < 2:
        even = [float(s == seen[0]) for s in sources] if seen else [(_UNITS // k + (i < _UNITS % k)) / _UNITS for i in range(k)]
        return texts.select("doc_id", F.array(*[F.lit(x) for x in even]).alias("member"))
    words = lambda d: d.withColumn("words", F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    tf = HashingTF(inputCol="words", outputCol="features", numFeatures=FEATURES)
    label = F.lit(0.0)
    for i, s in enumerate(seen):
        label = F.when(F.col("source") == s, float(i)).otherwise(label)
    model = NaiveBayes(smoothing=1.0).fit(tf.transform(words(labelled)).select("features", label.alias("label")))
    p = vector_to_array("probability")
    at = {s: i for i, s in enumerate(seen)}
    share = F.array(*[p[at[s]] * _UNITS if s in at else F.lit(0.0) for s in sources])
    got = model.transform(tf.transform(words(texts))).select("doc_id", share.alias("x"))
    # the units that rounding down leaves over go to the largest remainders
    got = got.withColumn("low", F.transform("x", lambda v: F.floor(v))).withColumn("over", F.lit(_UNITS) - F.aggregate("low", F.lit(0).cast("long"), lambda a, n: a + n))
    left = F.transform("x", lambda v, i: F.struct((v - F.floor(v)).alias("r"), (-i).alias("i")))
    got = got.withColumn("rank", F.slice(F.transform(F.sort_array(left, False), lambda v: -v["i"]), F.lit(1), F.greatest(F.col("over").cast("int"), F.lit(0))))
    return got.select("doc_id", F.transform("low", lambda n, i: (n + F.array_contains("rank", i).cast("int")) / F.lit(float(_UNITS))).alias("member"))


def likeliest(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, likeliest, share: what the classifier makes of every text, its own label left aside; ties by name.

    Rows with a null doc_id and empty and null texts are left out.
    """
    sources = [r.source for r in _goals(targets)]
    docs = _named(documents).filter(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    if not sources:
        return docs.select("doc_id", "source", F.lit("").alias("likeliest"), F.lit(0.0).alias("share")).limit(0)
    member = posteriors(docs.filter(F.col("source").isin(sources)), docs, sources)
    best = F.array_max(F.transform("member", lambda m, i: F.struct(m.alias("m"), (-i).alias("i"))))
    top = member.groupBy("doc_id").agg(F.max(best).alias("b"))
    names = F.array(*[F.lit(s) for s in sources])
    return docs.groupBy("doc_id").agg(F.min("source").alias("source")).join(top, "doc_id").select("doc_id", "source", names[-F.col("b.i")].alias("likeliest"), F.col("b.m").alias("share"))


def fit_rates(classes: DataFrame, targets: list[float], rounds: int = 40, close: float = 1e-6) -> DataFrame:
    """Adds ``rate`` in [0, cap] to classes (member, cap, n): sum(member * n * rate) comes close to ``targets``.

    Projected gradient on the squared residuals over the sources' tokens; a step needs one aggregate of a sum per source.
    """
    k = len(targets)
    sums = lambda w: [F.coalesce(F.sum(F.col("member")[s] * F.col("n") * w), F.lit(0.0)).alias(f"s{s}") for s in range(k)]
    have = list(classes.agg(*sums(F.lit(1.0))).first())
    out = classes.withColumn("rate", F.least(F.lit(1.0), F.col("cap").cast("double")))
    for i in range(rounds):
        off = [a - b for a, b in zip(out.agg(*sums(F.col("rate"))).first(), targets)]
        if max(map(abs, off), default=0.0) <= close * max(sum(targets), 1.0):
            break
        step = sum((F.col("member")[s] * (off[s] / have[s]) for s in range(k) if have[s]), F.lit(0.0))
        out = out.withColumn("rate", F.greatest(F.lit(0.0), F.least(F.col("cap").cast("double"), F.col("rate") - step)))
        if i % 8 == 7:
            out = cut(out)
    return out


def _goals(targets: DataFrame) -> list:
    """(source, target_share, max_repeats) by source; more than ``MAX_SOURCES`` of them are an error, never cut off."""
    rows = targets.filter("target_share > 0 AND max_repeats > 0").select(F.lower(blanks("source")).alias("source"), "target_share", "max_repeats")
    rows = rows.groupBy("source").agg(F.min_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("g")).select("source", "g.*")
    out = rows.orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(out) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    return out


def _plan(documents: DataFrame, targets: DataFrame, total: float | None, folder: str, name: str) -> tuple[DataFrame, list]:
    rows = _goals(targets)
    sources = [r.source for r in rows]
    docs = _named(documents).filter(F.col("doc_id").isNotNull() & (F.col("text") != ""))
    if not sources:
        return docs.select("doc_id", "source", F.lit(0).cast("long").alias("n_tokens"), F.array().cast("array<double>").alias("member"), F.lit(0.0).alias("rate"), F.lit(0).alias("cap")).limit(0), rows
    # equal texts are one text: only the first of them, in its own source, can be drawn. Texts themselves are not shuffled
    counted = token_counts(docs.withColumn("h", F.sha2("text", 256)), ["doc_id", "source", "h"], folder, name)
    first = cut(counted.groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*"))
    known = F.col("source").isin(sources)
    units = first.filter(known).select("*", _hot(sources).alias("member"))
    rest = first.filter(~known)
    if not rest.isEmpty():
        texts = docs.join(rest.select("doc_id", "source"), ["doc_id", "source"], "left_semi").dropDuplicates(["doc_id", "source"])
        units = units.union(rest.join(posteriors(docs.filter(known), texts, sources), "doc_id").select(*first.columns, "member"))
    scale = sum(r.target_share for r in rows)
    shares = [r.target_share / scale for r in rows]
    most = F.aggregate(F.zip_with("member", F.array(*[F.lit(float(r.max_repeats)) for r in rows]), lambda m, x: m * x), F.lit(0.0), lambda a, x: a + x)
    units = cut(units.withColumn("cap", F.floor(most + 1e-9).cast("int")))
    classes = cut(units.groupBy("member", "cap").agg(F.sum("n_tokens").alias("n")))
    room = list(classes.agg(*[F.coalesce(F.sum(F.col("member")[s] * F.col("n") * F.col("cap")), F.lit(0.0)) for s in range(len(rows))]).first())
    if total is None:  # a source without any text can't meet its share, and holds up no other
        total = min((room[s] / shares[s] for s in range(len(rows)) if room[s] > 0), default=0.0)
    rates = fit_rates(classes, [x * total if room[s] > 0 else 0.0 for s, x in enumerate(shares)])
    return lookup(units, rates.select("member", "cap", "rate"), ["member", "cap"], "inner").select("doc_id", "source", "n_tokens", "member", "rate", "cap"), rows


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, source, n_tokens, repeats: the texts drawn and how often.

    Reads doc_id, text, source and targets (source, target_share, max_repeats); sources are compared without case and
    outer blanks. ``total`` tokens are drawn, by default the most at which every target share can be met within the
    caps. A text that occurs in several rows counts as one text, under its smallest doc_id. Null and empty texts, and rows
    without doc_id, are never drawn; targets without share or repeats are left out; empty tables give no rows.
    """
    return _drawn(_plan(documents, targets, total, folder, name)[0]).select("doc_id", "source", "n_tokens", "repeats")


def _drawn(planned: DataFrame) -> DataFrame:
    part = F.col("rate") - F.floor("rate")
    h = planned.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS))).withColumn("part", part).withColumn("w", F.col("n_tokens") * part)
    sure = F.array_max("member") == 1.0
    h = h.withColumn("sure", sure)
    per = h.groupBy("source", "sure", "bucket").agg(F.sum("n_tokens").alias("t"), F.sum("part").alias("p"), F.sum("w").alias("w"))
    along, whole = Window.partitionBy("source", "sure").orderBy("bucket"), Window.partitionBy("source", "sure")
    before = per.select("source", "sure", "bucket", (F.sum("t").over(along) - F.col("t")).alias("t0"), (F.sum("p").over(along) - F.col("p")).alias("p0"), F.sum("w").over(whole).alias("want"))
    order = Window.partitionBy("source", "sure", "bucket").orderBy("h", "doc_id")
    at = lookup(h, before, ["source", "sure", "bucket"], "inner").withColumn("t1", F.col("t0") + F.sum("n_tokens").over(order)).withColumn("p1", F.col("p0") + F.sum("part").over(order))
    # texts of one source share a rate: one more repeat for the first of the hash order, until the wanted tokens are reached;
    # the others get one where the running sum of their rates passes a whole number
    pick = F.when(F.col("sure"), F.col("t1") - F.col("n_tokens") / 2 <= F.col("want")).otherwise(F.floor("p1") > F.floor(F.col("p1") - F.col("part")))
    repeats = F.least(F.col("cap"), (F.floor("rate") + F.when(pick, 1).otherwise(0)).cast("int"))
    return at.withColumn("repeats", repeats).filter("repeats > 0").select("doc_id", "source", "n_tokens", "member", "repeats")


def report(documents: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per target source: target_share, reached_share, n_tokens, n_texts and the most repeats of a text.

    A text without a known source counts towards the sources by its posterior.
    """
    planned, rows = _plan(documents, targets, total, TOKENIZERS, "byte_bpe_50k")
    drawn = cut(_drawn(planned))
    tokens = F.col("n_tokens") * F.col("repeats")
    m = drawn.select("doc_id", "repeats", tokens.alias("t"), F.posexplode("member").alias("at", "m")).filter("m > 0")
    per = m.groupBy("at").agg(F.sum(F.col("t") * F.col("m")).alias("n_tokens"), F.count("*").alias("n_texts"), F.max("repeats").alias("most_repeats"))
    all_ = drawn.agg(F.sum(tokens).alias("all_tokens"))
    goal = documents.sparkSession.createDataFrame([(i, r.source, r.target_share) for i, r in enumerate(rows)], "at int, source string, target_share double")
    n = F.coalesce("n_tokens", F.lit(0.0))
    out = goal.join(per, "at", "left").crossJoin(F.broadcast(all_))
    return out.select("source", "target_share", (n / F.col("all_tokens")).alias("reached_share"), n.alias("n_tokens"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
