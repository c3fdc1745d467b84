"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on each document. Expectation-
maximisation over the counts of vote patterns, from all documents, estimates each labeller's
accuracies and the share of good documents; a document's posterior is its training label. A
logistic regression over hashed word shapes learns those labels on about TRAIN_ROWS
different documents, picked by a hash of id and text, and scores every document.

Votes and features are built-in expressions within one row, made once and written to a table;
the driver holds pattern counts, at most 3 to the power of the labellers.

Results by case: a null, empty or blank text gets no votes and no features and is kept, as
nothing speaks against it; a null id stays null; repeated rows are scored each; other columns
are not carried (``keep_good`` keeps them all); an empty table gives an empty result, and
with only one class among the training labels the posterior is the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.rules import SPACE, let, words_of
from sitewright.shared import materialize

#: Documents that the scorer is fitted on, at most (about), and hashed features.
TRAIN_ROWS, FEATURES = 20_000, 1 << 14
#: Score from which a document is kept.
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2
#: Function words of the corpus' languages (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that it with for was on are as by this",
    "de la le et les des en un une du que est pour dans",
    "der die und das in den von zu mit sich des auf ist ein",
    "el los que y del las por con una su para al se",
)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(NONE))


def labellers() -> dict[str, Column]:
    """Each labeller's vote, from the measurements of ``measured``."""
    words, chars = F.col("n_words"), F.greatest(F.col("n_chars"), F.lit(1))
    share = lambda a, b: F.col(a) / F.greatest(b, F.lit(1))
    enough = words >= 20
    return {
        "symbols": _vote(share("n_symbols", words) > 0.2, share("n_symbols", words) < 0.02),
        "capitals": _vote(share("n_upper", chars) > 0.4, share("n_upper", chars) < 0.2),
        "shouts": _vote(share("n_shouts", words) > 0.2, share("n_shouts", words) < 0.02),
        "bars": _vote(share("n_bars", words) > 0.15, share("n_bars", words) < 0.02),
        "stutter": _vote(enough & (share("n_stutter", words) > 0.15), enough & (share("n_stutter", words) < 0.05)),
        "variety": _vote((words >= 50) & (F.col("n_distinct") < 0.12 * words) & (words < 5000), enough & (F.col("n_distinct") > 0.35 * words)),
        "function_words": _vote(enough & (share("n_function", words) < 0.03), enough & (share("n_function", words) > 0.08)),
        "word_length": _vote(enough & ((chars > 14 * words) | (chars < 2 * words)), enough & (chars < 9 * words) & (chars > 3 * words)),
        "sentences": _vote(enough & (F.col("n_ends") * 60 < words), enough & (F.col("n_ends") * 25 > words)),
    }


LABELLERS = 9


def measured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with a struct ``m`` of measurements and ``shapes``, from column ``text``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    listed = sorted({w for line in FUNCTION_WORDS for w in line.split()})
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "9")
    words = rows.withColumn("__words", words_of(whole)).withColumn("__shapes", words_of(shape))
    stutter = let(F.col("__words"), lambda w: F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    m = F.struct(
        F.size("__words").alias("n_words"),
        F.char_length(F.translate(whole, SPACE, "")).alias("n_chars"),
        F.regexp_count(whole, F.lit("[#*$%&<>]")).alias("n_symbols"),
        F.regexp_count(whole, F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count(whole, F.lit("!!")).alias("n_shouts"),
        F.regexp_count(whole, F.lit(r"\|")).alias("n_bars"),
        F.regexp_count(whole, F.lit(r"[\p{L}\p{N}][.?!](?=[ \t-\r]|\z)")).alias("n_ends"),
        F.size(stutter).alias("n_stutter"),
        F.size(F.array_distinct("__words")).alias("n_distinct"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(listed))).alias("n_function"),
        F.concat("__shapes", F.array_repeat(F.lit("\tstutter"), F.size(stutter))).alias("shapes"),
    )
    return words.select(*rows.columns, F.explode(F.array(m)).alias("m")).select(*rows.columns, "m.*")


def featured(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, with its hash ``text_hash``, ``votes`` (base 3), ``n_words`` and ``features``."""
    keep = [c for c in rows.columns if c != text]
    votes = sum((v * 3**k for k, v in enumerate(labellers().values())), F.lit(0)).cast("int")
    m = measured(rows.withColumn("text_hash", F.xxhash64(text)), text).select(*keep, "text_hash", "n_words", votes.alias("votes"), "shapes")
    hashed = HashingTF(numFeatures=FEATURES, inputCol="shapes", outputCol="counts").transform(m)
    return Normalizer(p=2.0, inputCol="counts", outputCol="features").transform(hashed).select(*keep, "text_hash", "n_words", "votes", "features")


@dataclass
class WeakLabels:
    """What expectation-maximisation found."""

    prior: float  # share of good documents
    right: np.ndarray  # [labeller, class, vote]: a vote's probability given the class and that there is one

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good for each vote pattern."""
        votes = (patterns[:, None] // 3 ** np.arange(LABELLERS)) % 3
        log = np.log([1 - self.prior, self.prior])[None] + sum(np.log(self.right[k][:, votes[:, k]]).T for k in range(LABELLERS))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Expectation-maximisation, begun from the majority of votes."""
    votes = (patterns[:, None] // 3 ** np.arange(LABELLERS)) % 3
    good, bad = (votes == GOOD).sum(1), (votes == BAD).sum(1)
    p = np.where(bad == 0, 0.95, np.where(good > 3 * bad, 0.4, 0.1))
    found = WeakLabels(0.5, np.ones((LABELLERS, 2, 3)))
    for _ in range(rounds):
        total = counts.sum() + 2
        prior = float(((p * counts).sum() + 1) / total)
        right = np.empty((LABELLERS, 2, 3))
        for k in range(LABELLERS):
            for c, weight in ((0, (1 - p) * counts), (1, p * counts)):
                tally = np.bincount(votes[:, k], weights=weight, minlength=3)[:2] + 0.5
                right[k, c] = [*tally / tally.sum(), 1.0]  # that a labeller says nothing tells nothing
        before, found = found, WeakLabels(prior, right)
        p = found.posterior(patterns)
        if abs(before.prior - prior) < 1e-9:
            break
    return found


@dataclass
class QualityModel:
    labels: WeakLabels
    scorer: LogisticRegressionModel | None

    def posterior(self, votes: Column) -> Column:
        """A vote pattern's posterior as a column expression."""
        terms = [F.lit(float(np.log(self.labels.prior / (1 - self.labels.prior))))]
        for k in range(LABELLERS):
            ratio = np.log(self.labels.right[k, 1] / self.labels.right[k, 0])
            vote = F.floor(votes / 3**k) % 3
            terms.append(F.when(vote == 0, F.lit(float(ratio[0]))).when(vote == 1, F.lit(float(ratio[1]))).otherwise(F.lit(float(ratio[2]))))
        return 1 / (1 + F.exp(-sum(terms[1:], terms[0])))

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``posterior`` and ``score``; a text without words scores 1."""
        out = rows.withColumn("posterior", F.when(F.col("n_words") == 0, F.lit(1.0)).otherwise(self.posterior(F.col("votes"))))
        if self.scorer is None:
            return out.withColumn("score", F.col("posterior"))
        from pyspark.ml.functions import vector_to_array

        scored = self.scorer.transform(out)
        return scored.withColumn("score", F.when(F.col("n_words") == 0, F.lit(1.0)).otherwise(vector_to_array("probability")[1])).drop("probability", "rawPrediction", "prediction")


def fit(rows: DataFrame, *, key: Column, train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on a table of ``featured`` rows; ``key`` and the text's hash pick the training rows,
    of which repeated ones count once."""
    patterns = rows.where("n_words > 0").groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    if not len(patterns):
        return QualityModel(WeakLabels(0.5, np.ones((LABELLERS, 2, 3))), None)
    patterns = patterns.sort_values("votes")
    labels = fit_labels(patterns["votes"].to_numpy(), patterns["n"].to_numpy().astype(float))
    model = QualityModel(labels, None)
    of_million = min(1_000_000, int(1_000_000 * train_rows / int(patterns["n"].sum())) + 1)
    picked = rows.where("n_words > 0").select("features", "votes", F.xxhash64(key, "text_hash").alias("pick")).where(F.pmod("pick", F.lit(1_000_000)) < of_million)
    sample = picked.groupBy("pick").agg(F.first("features").alias("features"), F.first("votes").alias("votes")).withColumn("p", model.posterior(F.col("votes")))
    soft = F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w")))
    train = materialize(sample.select("features", F.explode(soft).alias("s")).select("features", "s.label", "s.w").where("w > 0.0001"), "quality-train")
    if train.select("label").distinct().count() < 2:
        return model
    scorer = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=30, regParam=1e-6, standardization=True).fit(train)
    return QualityModel(labels, scorer)


def classify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, ``posterior``, ``score`` and ``kept`` of every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(featured(docs, "text"), "quality-features")
    model = fit(rows, key=F.col("doc_id"), train_rows=train_rows)
    return model.score(rows).select("doc_id", "posterior", "score", (F.col("score") >= THRESHOLD).alias("kept"))


def keep_good(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``df`` that the classifier keeps, with their columns as they are.

    Texts are measured once and never shuffle: rows are written with their features and
    read again for the verdict.
    """
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(text_col).cast("string").alias("__text"))
    rows = materialize(featured(held, "__text"), "quality-rows")
    model = fit(rows, key=F.col(f"row.`{id_col}`"), train_rows=train_rows)
    return model.score(rows).where(F.col("score") >= THRESHOLD).select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
