"""Document rates that bring a corpus to target weights over domains, by soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. A document that is used at
rate r adds r * tokens * posterior to the expected tokens of each domain. The rates, which may not be negative, are
fitted by projected gradient descent on the squared distance between these totals and the targets:

    rate <- max(0, rate - posterior . step),   step = inverse(sum of tokens * posterior posterior^T) (totals - targets)

starting from rate 1 everywhere. The metric weighs a document by its tokens and a domain by the inverse of what the
documents with a rate above 0 can move it, so two documents of equal posterior get equal rates; a step that
doesn't bring the totals nearer is halved. A round is one aggregation that returns a total for each domain; each row works out its rate from the steps
so far, so nothing but a few numbers for each round is kept.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import work_folder, written

VOCABULARY = 1 << 15
RARE = 0.003  # words in a smaller share of the sample are no features
SAMPLE = 20_000
ROUNDS = 60
CLOSE = 1e-6
#: Domain of a labelled row, by the columns of the labelled table.
DOMAINS = {"good": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
WEIGHTS = {"good": 0.85, "poor": 0.12, "toxic": 0.03}


def _words(text: Column) -> Column:
    """Lower-case words and, apart from them, runs of signs."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([^\p{L}\p{N}\s]+)", " $1 ")
    return F.split(F.trim(spaced), r"\s+")


def n_tokens(text: Column) -> Column:
    """Tokens as the mixture counts them: runs of anything but white space."""
    body = F.trim(F.coalesce(text, F.lit("")), F.lit("\t\n\x0b\x0c\r "))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def _features(rows: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    """Which words of the vocabulary a text holds."""
    return vocabulary.transform(rows.withColumn("_words", _words(F.col("body")))).drop("_words")


def posteriors(docs: DataFrame, labels: DataFrame, *, domains: Mapping[str, str] = DOMAINS, text: str = "text", id_: str = "doc_id",
               sample: int = SAMPLE) -> DataFrame:
    """(id, text_key, n_tokens, posterior) for each row of `docs`; the posterior has an entry for each domain, in order.

    The classifier, a sparse multinomial logistic regression on the presence of words, is fitted on about `sample` labelled
    documents at most (those whose id hashes lowest), which bounds its cost, its vocabulary and the broadcast of labels. Labelled rows
    with a null in a needed column, or whose document is missing, are left out; an id labelled more than once counts for
    its first domain. A domain without labelled rows has posterior 0; without any, all documents share
    the domains evenly.
    """
    spark = docs.sparkSession
    names = list(domains)
    folder = work_folder(spark, "mixing")
    which = F.coalesce(*[F.when(F.expr(rule), F.lit(i)) for i, rule in enumerate(domains.values())])
    known = labels.select(labels[id_].alias("l_id"), which.alias("domain")).where("l_id is not null and domain is not null")
    known = known.groupBy("l_id").agg(F.min("domain").alias("domain"))
    draw = F.pmod(F.xxhash64("l_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    known = written(known, f"{folder}/labelled")
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.broadcast(known.where(draw < share))  # about `sample` rows of two numbers
    rows = docs.select(docs[id_].alias("id"), docs[text].alias("body"))
    train = written(rows.join(chosen, F.col("id") == F.col("l_id")).where("body is not null").select("body", "domain"), f"{folder}/train")
    present = sorted(r["domain"] for r in train.select("domain").distinct().collect())
    counted = docs.select(docs[id_].alias("id"), F.xxhash64(docs[text]).alias("text_key"), n_tokens(docs[text]).alias("n_tokens"), docs[text].alias("body"))
    if len(present) < 2:
        even = [1.0 / len(names)] * len(names) if not present else [float(i == present[0]) for i in range(len(names))]
        return counted.select("id", "text_key", "n_tokens", F.lit(even).alias("posterior"))
    place = {domain: i for i, domain in enumerate(present)}
    numbered = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    vocabulary = CountVectorizer(inputCol="_words", outputCol="_features", minDF=RARE, vocabSize=VOCABULARY, binary=True).fit(
        train.select(_words(F.col("body")).alias("_words")))
    fitted = LogisticRegression(featuresCol="_features", labelCol="_label", family="multinomial", regParam=3e-3, elasticNetParam=1.0, maxIter=60).fit(
        _features(train.withColumn("_label", numbered[F.col("domain")].cast("double")), vocabulary))
    fitted.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_probability")
    scored = fitted.transform(_features(counted, vocabulary)).select("id", "text_key", "n_tokens", vector_to_array("_probability").alias("p"))
    parts = [F.col("p")[place[i]] if i in place else F.lit(0.0) for i in range(len(names))]
    return scored.select("id", "text_key", "n_tokens", F.array(*parts).alias("posterior"))


def _rate(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after all steps, each followed by the projection to rates of 0 or more."""
    return F.aggregate(F.lit(steps) if steps else F.array().cast("array<array<double>>"), F.lit(1.0),
                       lambda rate, step: F.greatest(F.lit(0.0), rate - F.aggregate(
                           F.zip_with(posterior, step, lambda p, s: p * s), F.lit(0.0), lambda x, y: x + y)))


def fit_steps(rows: DataFrame, weights: list[float], *, budget: float = 1.0, rounds: int = ROUNDS) -> tuple[list[list[float]], list[float]]:
    """Steps of the descent on `rows` (n_tokens, posterior), and the targets. Weights without tokens to meet them are left out."""
    size = len(weights)
    n = F.col("n_tokens").cast("double")
    p = F.col("posterior")

    def state(steps: list[list[float]]) -> tuple[float, np.ndarray, np.ndarray]:
        """All tokens, tokens of each domain at the rates so far, and the matrix of the documents that can move."""
        rated = rows.select(n.alias("n"), "posterior", _rate(p, steps).alias("rate"))
        moves = F.when(F.col("rate") > 0, F.col("n")).otherwise(0.0)
        sums = rated.agg(F.sum("n"), *[F.sum(F.col("n") * p[i] * F.col("rate")) for i in range(size)],
                         *[F.sum(moves * p[i] * p[j]) for i in range(size) for j in range(size)]).first()
        sums = [x or 0.0 for x in sums]
        return sums[0], np.array(sums[1:size + 1]), np.array(sums[size + 1:]).reshape(size, size)

    total, at, gram = state([])
    usable = [w if a > 0 else 0.0 for w, a in zip(weights, at, strict=True)]
    targets = [budget * total * w / sum(usable) if sum(usable) else float(a) for w, a in zip(usable, at, strict=True)]
    steps: list[list[float]] = []
    length = 1.0
    far = np.abs(at - targets).sum()
    while len(steps) < rounds and far > CLOSE * max(total, 1.0):
        tried = [*steps, [float(x) for x in length * (np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (at - targets))]]
        _, then, moved = state(tried)
        if np.abs(then - targets).sum() >= far:  # too long a step: documents at rate 0 came back
            length /= 2
            if length < 1e-3:
                break
            continue
        steps, at, gram, far = tried, then, moved, np.abs(then - targets).sum()
        length = min(1.0, 2 * length)
    return steps, targets


def rates(docs: DataFrame, labels: DataFrame, *, domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, float] = WEIGHTS,
          budget: float = 1.0, text: str = "text", id_: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of `docs`: id, text_key, n_tokens, posterior, rate and copies.

    `budget` is the wanted total as a share of the tokens there are. `copies` is the rate rounded up or down, at random by a
    hash of id and text with the rate as expectation. Null and empty texts have no tokens and a rate like others of
    their posterior; equal rows get equal rates and copies; an empty table gives no rows; other columns play no part.
    Domains without tokens are left out of the targets, and the other weights fill their share.
    """
    table = posteriors(docs, labels, domains=domains, text=text, id_=id_, sample=sample)
    table = written(table, f"{work_folder(docs.sparkSession, 'mixing')}/posteriors")
    steps, _ = fit_steps(table, [float(weights[name]) for name in domains], budget=budget)
    rated = table.withColumn("rate", _rate(F.col("posterior"), steps))
    draw = F.pmod(F.xxhash64("id", "text_key", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    return rated.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, each as often as its copies say (0 leaves it out), with the columns of `docs`."""
    decided = rates(docs, labels, text=text, id_=id_, **options).where("copies > 0").select(
        F.col("id").alias("m_id"), F.col("text_key").alias("m_key"), "copies").distinct()
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    rows = docs.select(row.alias("row"), docs[id_].alias("r_id"), F.xxhash64(docs[text]).alias("r_key"))
    kept = rows.join(decided, F.col("r_id").eqNullSafe(F.col("m_id")) & (F.col("r_key") == F.col("m_key")))
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
