"""Toxicity by non-negative positive-unlabelled learning.

Learned from texts confirmed as toxic and from unlabelled texts, which are toxic as often
as any (the class prior). What follows is not treated as non-toxic: the risk of calling
unlabelled text toxic is corrected by the share of it that is toxic, and kept from going
below zero, where a flexible model would only be memorising (Kiryo et al., 2017).

A text is seen as its distinct words and the beginnings of its words. How much more often
toxic than unlabelled texts have one is its weight; a few numbers about the weights in a
text go into a small numpy classifier. A text's own share in the weights is taken out
while learning, or every rare word would look like evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import fresh_name, quoted
from tablewright.llm.texts import REMEMBERED, map_texts, utf8

#: Texts that a model is learned from, at most; those with the smallest hashes of their ids.
POSITIVES = 3_000
UNLABELLED = 6_000
#: Bytes of the beginnings of words.
BEGINNINGS = (5, 6, 7)
#: Toxic texts that must share a word or beginning before it counts.
LEAST_TEXTS = 3
_SMOOTHING = 4.0
_DOUBT = 1.0
_FACTS = 8
_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())


@dataclass
class ToxicityModel:
    """Weights of word features, and a linear classifier of what they amount to in a text."""

    features: np.ndarray  # sorted ids
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    slope: np.ndarray
    bias: float

    def score(self, facts: np.ndarray) -> np.ndarray:
        return _sigmoid((facts - self.centre) / self.scale @ self.slope + self.bias)


def held_out(identity: str) -> Column:
    """The third of all identities whose labels nothing is learned from."""
    return F.coalesce(F.crc32(quoted(identity).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    positives: int = POSITIVES,
    unlabelled: int = UNLABELLED,
) -> ToxicityModel | None:
    """A model from texts whose ``label`` is 1 and from texts taken without regard to it.

    Only rows outside ``held_out`` are used, ``positives`` and ``unlabelled`` of them at
    most. The class prior is the share of 1 among all their labels. None without a toxic
    or an unlabelled text, or without a label that is not 1.
    """
    usable = labels.select(quoted(identity).alias("id"), quoted(label).alias("label")).where("label IS NOT NULL AND id IS NOT NULL")
    usable = usable.where(~held_out("id"))
    prior = usable.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    if prior is None or not 0 < prior < 1:
        return None
    by_hash = [F.xxhash64("id"), F.col("id")]
    toxic = usable.where("label = 1").select("id").distinct().orderBy(*by_hash).limit(positives)
    others = docs.select(quoted(identity).alias("id")).where("id IS NOT NULL").where(~held_out("id")).distinct()
    others = others.orderBy(*by_hash).limit(unlabelled)
    # Both lists are bounded by the two parameters.
    asked = toxic.withColumn("toxic", F.lit(True)).union(others.withColumn("toxic", F.lit(False)))
    rows = docs.select(quoted(identity).alias("id"), utf8(quoted(text)).alias("words"))
    sample = rows.join(F.broadcast(asked), "id").select("toxic", "words").mapInArrow(_word_features, "toxic boolean, features binary")
    # Rows that repeat an identity cannot make the sample any longer than that.
    found = sample.limit(2 * (positives + unlabelled)).toArrow()
    # Copies of a text would make its rare words look common.
    distinct = sorted(set(zip(found.column("toxic").to_pylist(), found.column("features").to_pylist(), strict=True)))
    del found
    matrices = [np.frombuffer(x, np.uint64).reshape(-1, 1 + len(BEGINNINGS)) for _, x in distinct]
    flags = np.array([x for x, _ in distinct], bool)
    if not flags.any() or flags.all():
        return None
    return _fit(matrices, flags, float(prior))


def toxicity_scores(docs: DataFrame, model: ToxicityModel | None, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where toxic is likelier. Without a model all are 0.

    Whole texts are scored; null, empty and wordless texts get what a text without any
    sign gets. Rows that repeat score alike.
    """
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("value", T.DoubleType())])
    known = _WordWeights(shared)
    made = map_texts(docs, text, name, kind, lambda texts: [_scores(texts, known)])
    return made.withColumn(name, quoted(name)["value"])


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.7, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with the columns they had."""
    name = fresh_name(docs, "toxicity")
    return toxicity_scores(docs, learn_toxicity(docs, labels, identity, text), name, text).where(quoted(name) < limit).drop(name)


def _features(word: bytes) -> list[int]:
    plain = word.lower().strip(_PUNCTUATION)
    whole = xxhash.xxh3_64_intdigest(plain)
    return [whole, *(xxhash.xxh3_64_intdigest(plain[:n], n) if len(plain) > n else whole for n in BEGINNINGS)]


def _word_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each text's distinct words, a row of numbers each."""
    for batch in batches:
        found = [np.array([_features(w) for w in sorted(set(x.split()))], np.uint64).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["toxic", "features"])


class _WordWeights(dict):
    """The weight of each word, remembered up to a bound."""

    def __init__(self, model: Broadcast) -> None:
        super().__init__()
        self._model = model
        self._weights: dict[int, float] | None = None

    def __reduce__(self) -> tuple:
        return _WordWeights, (self._model,)

    @property
    def model(self) -> ToxicityModel:
        return self._model.value

    def __missing__(self, word: bytes) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        if self._weights is None:
            self._weights = dict(zip(self.model.features.tolist(), self.model.weights.tolist(), strict=True))
        value = self[word] = max(0.0, *(self._weights.get(x, 0.0) for x in _features(word)))
        return value


def _lookup(features: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The largest weight among each word's features, 0 if it has none."""
    if not len(known):
        return np.zeros(len(features))
    at = np.minimum(np.searchsorted(known, features), len(known) - 1)
    return np.where(known[at] == features, weights[at], 0).max(axis=1, initial=0)


def _facts(weights: np.ndarray, owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the weights of each text's distinct words amount to; ``words`` counts all its words."""
    texts = len(words)
    facts = np.zeros((texts, _FACTS))
    facts[:, 0] = np.log1p(words)
    kept = weights > 0
    weights, owner = weights[kept], owner[kept]
    order = np.lexsort((-weights, owner))
    weights, owner = weights[order], owner[order]
    first = np.searchsorted(owner, np.arange(texts))
    count = np.bincount(owner, minlength=texts)
    for k in range(3):
        there = count > k
        facts[there, 1 + k] = weights[first[there] + k]
    for k, limit in enumerate((0.7, 1.2, 1.7)):
        strong = np.bincount(owner[weights > limit], minlength=texts)
        facts[:, 4 + k] = np.log1p(strong)
    facts[:, 7] = 10 * np.bincount(owner[weights > 1.2], minlength=texts) / np.maximum(words, 20)
    return facts


def _scores(texts: list[bytes], known: _WordWeights) -> np.ndarray:
    words = [x.split() for x in texts]
    distinct = [set(x) for x in words]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in distinct])
    weights = np.fromiter((known[w] for x in distinct for w in x), float, len(owner))
    return known.model.score(_facts(weights, owner, np.array([len(x) for x in words])))


def _fit(matrices: list[np.ndarray], toxic: np.ndarray, prior: float) -> ToxicityModel:
    own = [np.unique(x) for x, t in zip(matrices, toxic, strict=True) if t]
    features, in_toxic = np.unique(np.concatenate(own), return_counts=True)
    enough = in_toxic >= LEAST_TEXTS
    features, in_toxic = features[enough], in_toxic[enough]
    in_unlabelled = np.zeros(len(features), np.int64)
    for x, t in zip(matrices, toxic, strict=True):
        if not t and len(features):
            there = np.unique(x)
            at = np.minimum(np.searchsorted(features, there), len(features) - 1)
            in_unlabelled[at[features[at] == there]] += 1
    n_toxic, n_unlabelled = int(toxic.sum()), int((~toxic).sum())

    def log_ratio(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
        """How much likelier a toxic text has it: the lower end of what few texts leave open."""
        usual = (u + 1) / (n_u + 2)
        return np.log((p + _SMOOTHING * usual) / (n_p + _SMOOTHING) / usual) - _DOUBT / np.sqrt(np.maximum(p, 1))

    weights = log_ratio(in_toxic, in_unlabelled, n_toxic, n_unlabelled)
    # A text is judged by what the others say.
    as_toxic = log_ratio(in_toxic - 1, in_unlabelled, max(1, n_toxic - 1), n_unlabelled)
    as_other = log_ratio(in_toxic, np.maximum(in_unlabelled - 1, 0), n_toxic, max(1, n_unlabelled - 1))
    rows = [_lookup(x, features, as_toxic if t else as_other) for x, t in zip(matrices, toxic, strict=True)]
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    facts = _facts(np.concatenate(rows) if rows else np.zeros(0), owner, np.array([len(x) for x in matrices]))
    centre, scale = facts.mean(axis=0), facts.std(axis=0) + 1e-6
    slope, bias = _non_negative_pu((facts - centre) / scale, toxic, prior)
    return ToxicityModel(features, weights, centre, scale, slope, bias)


def _non_negative_pu(x: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 1500, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear classifier with the smallest non-negative PU risk under the logistic loss.

    risk = prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]), by Adam steps; where
    the second part is below zero, its gradient is followed upwards instead.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    p, u = x[toxic], x[~toxic]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    penalty = np.append(np.full(len(w) - 1, decay), 0)
    for step in range(1, rounds + 1):
        z_p, z_u = p @ w, u @ w
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        positive = prior * ((s_p - 1) @ p) / len(p)
        negative = (s_u @ u) / len(u) - prior * (s_p @ p) / len(p)
        below = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean() < 0
        gradient = (-negative if below else positive + negative) + penalty * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
