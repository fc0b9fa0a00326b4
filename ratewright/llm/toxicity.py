"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are used to fit: the unlabelled part stands
for what documents look like at large, toxic ones among them. With the share ``prior`` of toxic
documents, the risk of a classifier g on clean text is the risk on unlabelled text minus the
toxic share of it,

    R(g) = prior * R_p(g, toxic) + max(0, R_u(g, clean) - prior * R_p(g, clean)),

and where a batch drives the second term below zero, the step goes the other way on it
(Kiryo et al., 2017). The classifier is linear in which words and parts of words a text holds,
with a logistic loss, fitted in numpy by Adam. The sample is cut into ``FOLDS`` parts; one model is
fitted without each, and the classifier is their mean. Every sampled text has a logit from the
model that has not seen it, and all of these turn logits into probabilities: prior * density
among toxic / density among unlabelled, made monotone.

The fit uses a bounded sample, chosen by a hash: ``positives`` toxic and ``unlabelled`` rows in
expectation, and the ``features`` that stand out most among the toxic ones. Every whole text is
scored.

Defined results: null and empty texts are scored as texts without features; without toxic examples every
score is 0; repeated rows score alike; null ids are kept; labels, ids and other columns never
influence a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.sources import work_path

POSITIVES = 4000
UNLABELLED = 12_000
FEATURES = 4000
# A feature must be in this many sampled texts, and in more toxic ones than chance would put
# there by so many standard deviations.
MIN_DOCUMENTS = 5
MIN_DEVIATIONS = 4.5
PART_BYTES = (4, 5)
STEPS = 3000
# Parts of the sample, each kept from one of the models.
FOLDS = 4
BATCH = 512
REMEMBERED_WORDS = 300_000
STEP = 0.02
DECAY = 1e-4

# Everything but letters and bytes beyond ASCII parts words; A-Z become a-z.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> set[bytes]:
    """The different words of a text."""
    return set((text or b"").translate(_FOLD).split())


def features_of(word: bytes) -> set[bytes]:
    """The word itself, and its parts of ``PART_BYTES`` bytes with the ends marked."""
    marked = b"^" + word + b"$"
    return {
        b"=" + word,
        *(marked[i : i + n] for n in PART_BYTES for i in range(len(marked) - n + 1)),
    }


class Numbers(dict):
    """word -> numbers of its known features, remembered for the words that come again."""

    def __init__(self, number_of: dict[bytes, int]):
        super().__init__()
        self.number_of = number_of

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        number_of = self.number_of
        found = self[word] = tuple(number_of[f] for f in features_of(word) if f in number_of)
        return found

    def of(self, text: bytes | None) -> list[int]:
        """The numbers of a text's known features, in order."""
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return sorted(set().union(*map(self.__getitem__, words_of(text))))


class Model(NamedTuple):
    number_of: dict[bytes, int]
    weights: np.ndarray
    bias: float
    logits: np.ndarray  # increasing, with the probability of each
    chances: np.ndarray

    def scores(self, texts: list[bytes | None], memo: Numbers) -> np.ndarray:
        logits = np.array([self.weights[memo.of(t)].sum() + self.bias for t in texts], float)
        plain = _sigmoid(logits)
        if not len(self.logits):
            return plain
        # A little of the plain score keeps the order where the probability is level.
        return 0.98 * np.interp(logits, self.logits, self.chances) + 0.02 * plain


NO_MODEL = Model({}, np.zeros(0), -50.0, np.zeros(0), np.zeros(0))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def calibrate(toxic: np.ndarray, any_text: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Logits and the probability of toxic at each, from logits of texts that were not fitted.

    The ratio prior * toxic density / density of all, pooled until it never falls as the logit
    rises.
    """
    logits = np.concatenate([toxic, any_text])
    mass = np.repeat([prior / max(1, len(toxic)), 0.0], [len(toxic), len(any_text)])
    base = np.repeat([0.0, 1 / max(1, len(any_text))], [len(toxic), len(any_text)])
    pools: list[list[float]] = []  # mass, base, sum of logits, number
    for i in np.argsort(logits, kind="stable"):
        pools.append([mass[i], base[i], logits[i], 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    centres = np.array([p[2] / p[3] for p in pools])
    chances = np.array([min(1.0, p[0] / p[1]) if p[1] else 1.0 for p in pools])
    return centres, chances


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], features: int, prior: float,
    steps: int = STEPS, seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights and bias from the feature numbers of each text."""
    random = np.random.default_rng(seed)
    weights = np.zeros(features + 1)  # the last is the bias
    mean, square, step = np.zeros_like(weights), np.zeros_like(weights), 0
    weights[-1] = np.log(prior / (1 - prior))

    def part(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
        of = np.repeat(np.arange(len(rows)), sizes)
        logits = np.bincount(of, weights[flat], len(rows)) + weights[-1]
        return flat, of, logits

    def gradient(flat, of, per_text) -> np.ndarray:
        out = np.bincount(flat, per_text[of], features + 1).astype(float)
        out[-1] = per_text.sum()
        return out

    sigmoid = _sigmoid
    softplus = lambda z: np.logaddexp(0, z)
    batches = max(1, len(unlabelled) // BATCH)
    per_batch = max(1, min(len(positive), BATCH // 2))
    for _ in range(max(1, steps // batches)):
        for chosen in np.array_split(random.permutation(len(unlabelled)), batches):
            own = random.choice(len(positive), per_batch, replace=False)
            p_flat, p_of, p = part([positive[i] for i in own])
            u_flat, u_of, u = part([unlabelled[i] for i in chosen])
            clean = softplus(u).mean() - prior * softplus(p).mean()
            clean_gradient = gradient(u_flat, u_of, sigmoid(u) / len(u)) - gradient(
                p_flat, p_of, prior * sigmoid(p) / len(p)
            )
            if clean < 0:
                slope = -clean_gradient
            else:
                slope = clean_gradient + gradient(p_flat, p_of, -prior * sigmoid(-p) / len(p))
            slope[:-1] += DECAY * weights[:-1]
            step += 1
            mean = 0.9 * mean + 0.1 * slope
            square = 0.999 * square + 0.001 * slope**2
            weights -= STEP * (mean / (1 - 0.9**step)) / (
                np.sqrt(square / (1 - 0.999**step)) + 1e-8
            )
    return weights[:-1], float(weights[-1])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
    features: int = FEATURES,
    min_documents: int = MIN_DOCUMENTS,
) -> Model:
    """A model from the documents that ``labels`` confirms as toxic and a sample of all.

    The share of toxic documents is taken from the labelled ones. The driver gets numbers of
    features for the rows of the bounded sample, not texts.
    """
    spark = docs.sparkSession
    space = 1 << 30
    at = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(space))
    marked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .filter("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    sizes = marked.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.expr("int(label = 1)")), F.lit(0)).alias("toxic")
    ).first()
    if not sizes["toxic"]:
        return NO_MODEL
    prior = min(0.9, sizes["toxic"] / sizes["n"])
    wanted = marked.filter("label = 1").filter(
        at < int(space * min(1.0, positives / sizes["toxic"]))
    ).select("id", F.lit(1).alias("positive"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    number = docs.count()
    # The ids wanted are a bounded sample, so they can go to every task.
    confirmed = texts.join(F.broadcast(wanted), "id").select("positive", "text")
    others = texts.filter(at < int(space * min(1.0, unlabelled / max(1, number)))).select(
        F.lit(0).alias("positive"), "text"
    )
    path = work_path(spark, "toxicity-sample")
    confirmed.unionByName(others).write.parquet(path)
    sample = spark.read.schema("positive int, text binary").parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for positive, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = set().union(*map(features_of, words_of(text.as_py())))
                counts[positive].update(found)
                counts[positive][b""] += 1  # the number of texts
        every = list(counts[0].keys() | counts[1].keys())
        for start in range(0, len(every), 100_000):
            part = every[start : start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.binary()), *(pa.array([c[f] for f in part]) for c in counts)],
                names=["feature", "any", "toxic"],
            )

    counted = (
        sample.mapInArrow(count, "feature binary, any bigint, toxic bigint")
        .groupBy("feature").agg(F.sum("any").alias("any"), F.sum("toxic").alias("toxic"))
    )
    counts_path = work_path(spark, "toxicity-features")
    counted.write.parquet(counts_path)
    counted = spark.read.schema(counted.schema).parquet(counts_path)
    total = counted.filter(F.length("feature") == 0).first()
    if total is None or not total["any"] or not total["toxic"]:
        return NO_MODEL
    share = F.greatest(F.col("any"), F.lit(0.5)) / float(total["any"])
    chance = F.sqrt(share * F.abs(1 - share) / float(total["toxic"]) + F.lit(1e-9))
    deviations = (F.col("toxic") / float(total["toxic"]) - share) / chance
    chosen = (
        counted.filter(F.length("feature") > 0)
        .filter((F.col("any") + F.col("toxic") >= min_documents) & (F.col("toxic") > 1))
        .select("feature", deviations.alias("deviations"))
        .filter(F.col("deviations") > MIN_DEVIATIONS)
        .orderBy(F.desc("deviations"), "feature").limit(features).collect()
    )
    number_of = {bytes(r["feature"]): i for i, r in enumerate(chosen)}
    shared = spark.sparkContext.broadcast(number_of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Numbers(shared.value)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1)]
            # A toxic text is in the unlabelled part too: by its content it gets the same fold.
            folds = [zlib.crc32(t) % FOLDS for t in texts]
            found = [memo.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(folds, pa.int32()), pa.array(found, pa.list_(pa.int32()))],
                names=["positive", "fold", "numbers"],
            )

    rows = sample.mapInArrow(encode, "positive int, fold int, numbers array<int>").toArrow()
    # A fixed order, whatever the order of arrival, so that every run fits the same model.
    parts: dict[int, list[tuple[int, np.ndarray]]] = {0: [], 1: []}
    for positive, fold, row in sorted(
        zip(*(c.to_pylist() for c in rows.columns[:2]), (r.as_py() for r in rows.column(2)), strict=True)
    ):
        parts[positive].append((fold, np.array(row, np.int64)))
    if not parts[0] or not parts[1]:
        return NO_MODEL
    weights, bias, toxic, any_text = cross_fit(parts[1], parts[0], len(number_of), prior)
    return Model(number_of, weights, bias, *calibrate(toxic, any_text, prior))


def cross_fit(
    positive: list[tuple[int, np.ndarray]], unlabelled: list[tuple[int, np.ndarray]],
    features: int, prior: float, steps: int = STEPS,
) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Mean weights and bias of one model per fold, and the logit of each text by the model that
    was fitted without it; texts are (fold, feature numbers). A fold that holds all texts of a
    kind is not kept from its model."""
    models = []
    logits = [np.zeros(len(positive)), np.zeros(len(unlabelled))]
    for fold in range(FOLDS):
        used = []
        for rows in (positive, unlabelled):
            others = [r for f, r in rows if f != fold]
            used.append(others or [r for _, r in rows])
        weights, bias = fit(*used, features, prior, steps)
        models.append((weights, bias))
        for own, rows in zip(logits, (positive, unlabelled), strict=True):
            for i, (f, row) in enumerate(rows):
                if f == fold:
                    own[i] = weights[row].sum() + bias
    mean = np.mean([w for w, _ in models], axis=0)
    return mean, float(np.mean([b for _, b in models])), *logits


def score(
    docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns in ``carry`` and ``score`` (0 to 1, higher: more likely toxic) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        memo = Numbers(own.number_of)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(own.scores(texts, memo))],
                names=[*batch.schema.names[:-1], "score"],
            )

    inner = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(
        *(F.col(c).alias(n) for c, n in zip(carry, inner, strict=True)),
        F.col(text_col).cast("binary").alias("t"),
    )
    kinds = "".join(f"{n} {t}, " for n, t in rows.dtypes[:-1])
    out = rows.mapInArrow(run, f"{kinds}score double")
    return out.withColumnsRenamed(dict(zip(inner, carry, strict=True)))
