"""Operator 5: toxicity by multiple-instance learning: a document is toxic if any of its sentences is."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shingles import mix
from .store import Stage

#: Bound of the labelled rows that the model is fitted on, whole texts all. Scoring has no bounds.
SAMPLE_ROWS = 8000
SLOTS = 1 << 18
CHUNK_BYTES = 4 << 20
#: The most epochs of a fit; how many are used, a part of the learnable rows decides.
EPOCHS = 24
#: Besides the whole word, its first bytes are features, for inflected and compound words.
PREFIXES = (4, 5, 6)

_VALUES = mix(np.arange(11, 267, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_SALTS = mix(np.arange(1, 2 + len(PREFIXES), dtype=np.uint64)) | np.uint64(1)


@dataclass
class Sentences:
    """Words of a batch of texts: feature slots per word, the first word of each sentence, the first sentence of each text."""

    features: np.ndarray
    first_word: np.ndarray
    first_sentence: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(texts: list[bytes]) -> Sentences:
    """Sentences end at ``. ! ?`` or a line end; those without a word are none. ``start, end``: bytes in their text."""
    body = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8).copy()
    upper = (body >= 65) & (body <= 90)
    upper[1:] |= (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
    body[upper] += 32
    letter = _LETTER[body]
    turns = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = turns[0::2] + 1, turns[1::2] + 1
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Sentences(np.zeros((1 + len(PREFIXES), 0), np.int32), none, np.zeros(len(at), np.int64), none, none)
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inside = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    terms = _VALUES[body[letter]] * np.multiply.accumulate(powers)[inside]
    features = np.empty((1 + len(PREFIXES), len(starts)), np.int32)
    for k, n in enumerate((0, *PREFIXES)):
        sums = np.add.reduceat(terms if not n else terms * (inside < n), offsets)
        features[k] = (mix(sums * _SALTS[k]) >> np.uint64(64 - 18)).astype(np.int32)
        if n:
            features[k][lengths <= n] = SLOTS  # the slot that always weighs 0
    number = np.cumsum(_END[body])[starts]
    first_word = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
    first_sentence = np.searchsorted(starts[first_word], at)
    last_word = np.concatenate([first_word[1:], [len(starts)]]) - 1
    base = np.repeat(at[:-1], np.diff(first_sentence))
    return Sentences(features, first_word, first_sentence, starts[first_word] - base, ends[last_word] - base)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; ``first`` has their starts, increasing, none of them empty."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0)


@dataclass
class Model:
    """Weights of the slots (the last is the unused one), the bias of a sentence's logit and the leak, a logit per document."""

    weights: np.ndarray
    bias: float
    leak: float = -40.0

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        return np.clip(_sums(self.weights[s.features].sum(axis=0), s.first_word) + self.bias, -40, 40)

    def document_scores(self, logits: np.ndarray, first_sentence: np.ndarray) -> np.ndarray:
        """Noisy-or of the leak and of all sentences, each by what it adds to the base rate; 0 without sentences.

        A sentence without evidence is at the base rate and adds nothing, so a clean text of any length scores as the
        leak alone.
        """
        counts = np.diff(first_sentence)
        doc = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(doc, excess(logits, self.bias), minlength=len(counts))
        return np.where(counts > 0, -np.expm1(-total - softplus(self.leak)), 0.0)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def excess(z: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - q) of sentences, q = (p - p0) / (1 - p0) where p0 is the bias alone; 0 where p <= p0."""
    return np.maximum(softplus(z) - softplus(bias), 0)


def live_slots(seen: np.ndarray, positive: np.ndarray, share: float, *, least_z: float = 4.0) -> np.ndarray:
    """The slots that lie in more positive documents than chance allows, by ``least_z`` standard errors.

    Only these get a weight: the others would only let the model remember single documents.
    """
    live = positive - share * seen >= least_z * np.sqrt(seen * share * (1 - share) + 1e-9)
    live &= positive >= 2
    live[SLOTS] = False
    return live


@dataclass
class Batch:
    """Documents of a step: slots of their words, the sentence of each word, the document of each sentence, the labels."""

    features: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    target: np.ndarray

    def total(self, weights: np.ndarray, bias: float, leak: float) -> tuple[np.ndarray, np.ndarray]:
        """(logits of the sentences, -log of the chance that a document is clean)."""
        z = np.clip(np.bincount(self.sentence, weights[self.features].sum(axis=0), minlength=len(self.doc)) + bias, -40, 40)
        return z, np.bincount(self.doc, excess(z, bias), minlength=len(self.target)) + softplus(leak)


def batches_of(words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int) -> list[Batch]:
    order, out = np.random.default_rng(5).permutation(len(words)), []
    for i in range(0, len(order), size):
        own = order[i : i + size]
        numbers = np.concatenate([words[j][0] for j in own])
        doc = np.repeat(np.arange(len(own)), [len(words[j][0]) for j in own])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (numbers[1:] != numbers[:-1])
        out.append(Batch(np.concatenate([words[j][1] for j in own], axis=1), np.cumsum(new) - 1, doc[new], labels[own].astype(float)))
    return out


def log_loss(score: np.ndarray, target: np.ndarray) -> float:
    score = np.clip(score, 1e-9, 1 - 1e-9)
    return float(-(target * np.log(score) + (1 - target) * np.log1p(-score)).mean())


def descend(batches: list[Batch], live: np.ndarray, *, epochs: int = EPOCHS, rate: float = 0.15, decay: float = 1e-5):
    """Yields the model after each epoch: Adam on the documents' log loss, through the noisy-or of all their sentences.

    The step's size falls with the epochs to come, so an epoch's model doesn't depend on where one stops.
    """
    weights, both = np.zeros(SLOTS + 1), np.array([-5.0, -5.0])
    m, v, t = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1), 0
    mb, vb = np.zeros(2), np.zeros(2)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.005
        for b in batches:
            t += 1
            bias, leak = both
            z, total = b.total(weights, bias, leak)
            score = np.clip(-np.expm1(-total), 1e-9, 1 - 1e-9)
            # d loss / d total of each document, then of each sentence above the base rate
            pull = np.where(b.target > 0, -(1 - score) / score, 1.0) / len(b.target)
            own = np.where(z >= bias, pull[b.doc], 0)
            p, p0, pl = (1 / (1 + np.exp(-x)) for x in (z, bias, leak))
            g = (p * own)[b.sentence]
            grad = sum(np.bincount(f, g, minlength=SLOTS + 1) for f in b.features)
            grad = np.where(live, grad + decay * weights, 0)
            other = np.array([(own * (p - p0)).sum(), pl * pull.sum()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            mb, vb = 0.9 * mb + 0.1 * other, 0.99 * vb + 0.01 * other**2
            a, c = 1 - 0.9**t, 1 - 0.99**t
            weights = weights - step * (m / a) / (np.sqrt(v / c) + 1e-6)
            both = both - step * (mb / a) / np.sqrt(vb / c + 1e-12)
        yield Model(weights.astype(np.float32), float(both[0]), float(both[1]))


def fit(words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, live: np.ndarray, aside: np.ndarray | None = None, *, size: int = 256) -> Model:
    """The model of the epoch that suits the rows ``aside`` best, fitted on all rows; without ``aside``, of the last epoch.

    ``words``: of each document with sentences the words that have a live feature, as (number of their sentence in the
    document, ascending; slots of the word by column, SLOTS for those not live). Other words add nothing. ``aside``
    marks rows that the first fit leaves out. Without a positive label the model scores 0 everywhere.
    """
    if not len(words) or not labels.any():
        return Model(np.zeros(SLOTS + 1, np.float32), -40.0)
    best = EPOCHS
    if aside is not None and labels[aside].any() and labels[~aside].any():
        some = [np.flatnonzero(aside), np.flatnonzero(~aside)]
        check, rest = (batches_of([words[i] for i in own], labels[own], size) for own in some)
        losses = []
        for model in descend(rest, live):
            found = [(-np.expm1(-b.total(model.weights, model.bias, model.leak)[1]), b.target) for b in check]
            losses.append(log_loss(*(np.concatenate(x) for x in zip(*found, strict=True))))
        best = 1 + int(np.argmin(losses))
    for n, model in enumerate(descend(batches_of(words, labels, size), live), 1):
        if n == best:
            return model
    raise AssertionError("an epoch is chosen")


def held_out(id_col: str) -> Column:
    """Whether the CRC-32 of the id as text leaves no remainder by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _chunks(texts: list[bytes]):
    """Ranges i, j of texts of CHUNK_BYTES together, or of one text."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK_BYTES):
            held += len(texts[j])
            j += 1
        yield i, j
        i = j


def _docs_of_words(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the number of its sentence and of its text."""
    sentence = np.repeat(np.arange(len(s.first_word)), np.diff(np.concatenate([s.first_word, [s.features.shape[1]]])))
    return sentence, np.repeat(np.arange(len(s.first_sentence) - 1), np.diff(s.first_sentence))[sentence]


def _counted(batches):
    """Rows ``slot, seen, positive``: in how many texts and positive texts a slot is; slot -1 counts the texts."""
    seen, positive = np.zeros(SLOTS + 1, np.int64), np.zeros(SLOTS + 1, np.int64)
    n = n_positive = 0
    for batch in batches:
        labels = np.array(batch.column(1).to_pylist(), np.int64)
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        n, n_positive = n + len(texts), n_positive + int((labels > 0).sum())
        for i, j in _chunks(texts):
            s = sentences(texts[i:j])
            _, doc = _docs_of_words(s)
            pairs = np.unique((s.features.astype(np.int64) * (j - i) + doc).ravel())
            slots = pairs // (j - i)
            seen += np.bincount(slots, minlength=SLOTS + 1)
            positive += np.bincount(slots[labels[i:j][pairs % (j - i)] > 0], minlength=SLOTS + 1)
    some = np.flatnonzero(seen)
    made = ([-1, *some], [n, *seen[some]], [n_positive, *positive[some]])
    yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in made], names=["slot", "seen", "positive"])


def _live_words(batches, live: np.ndarray):
    """Rows ``i, y, numbers, slots`` of the texts that have sentences: their words with a live feature, for :func:`fit`."""
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        rows, numbers, slots = [], [], []
        for i, j in _chunks(texts):
            s = sentences(texts[i:j])
            sentence, doc = _docs_of_words(s)
            some = np.flatnonzero(live[s.features].any(axis=0))
            features = np.where(live[s.features[:, some]], s.features[:, some], SLOTS)
            cuts = np.searchsorted(doc[some], np.arange(j - i + 1))
            for k in np.flatnonzero(np.diff(s.first_sentence)):
                own = slice(cuts[k], cuts[k + 1])
                rows.append(i + int(k))
                numbers.append((sentence[some[own]] - s.first_sentence[k]).astype(np.int32))
                slots.append(features[:, own].astype(np.int32).ravel())
        taken = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
        lists = [pa.array(x, pa.list_(pa.int32())) for x in (numbers, slots)]
        yield pa.RecordBatch.from_arrays([*taken.columns, *lists], names=["i", "y", "numbers", "slots"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most ``rows`` labelled documents of any length, the smallest by a hash of the id.

    Rows with a null id, text or label are not learned from; an id labelled twice counts as toxic if one label is, and
    an id with several texts counts with one of them, always the same. Without labelled rows, or without a positive one,
    the model scores 0 everywhere; very long texts count whole. A fifth of the sample, by a second hash of the id, says
    after how many epochs to stop; rows held out play no part in it. Columns other than those named are not looked at. The
    texts stay with the tasks: the driver gets counts by slot, then the words that have a live feature.
    """
    stage = Stage(spark, "toxicity")
    known = docs.where(F.col(text_col).isNotNull() & ~held_out(id_col) & F.col(id_col).isNotNull())
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_tx_id")).agg(F.max(label_col).alias("_tx_y"))
    chosen = (
        known.select(F.col(id_col).alias("_tx_id")).distinct().join(marks, "_tx_id")
        .orderBy(F.xxhash64("_tx_id", F.lit(5)), "_tx_id").limit(rows)
    )
    # a bounded table: at most ``rows`` ids and labels
    sample = known.join(F.broadcast(chosen), F.col(id_col) == F.col("_tx_id")).select(
        F.col("_tx_id").alias("i"), F.col("_tx_y").cast("int").alias("y"), F.col(text_col).cast("string").alias("t")
    )
    # of several texts of an id the least by hash, so reruns agree
    sample = stage.save(sample.groupBy("i").agg(F.first("y").alias("y"), F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")))
    found = sample.mapInArrow(_counted, "slot long, seen long, positive long").groupBy("slot").agg(F.sum("seen").alias("seen"), F.sum("positive").alias("positive")).toArrow()
    slot, seen, positive = (np.array(found.column(c).to_pylist(), np.int64) for c in ("slot", "seen", "positive"))
    of_slot = np.zeros((2, SLOTS + 1))
    of_slot[:, slot[slot >= 0]] = seen[slot >= 0], positive[slot >= 0]
    live = live_slots(*of_slot, positive[slot < 0].sum() / max(1, seen[slot < 0].sum()))
    kind = sample.schema["i"].dataType.simpleString()
    words = sample.mapInArrow(lambda batches: _live_words(batches, live), f"i {kind}, y int, numbers array<int>, slots array<int>").toArrow()
    stage.drop(sample)
    ids, y = words.column("i").to_pylist(), np.array(words.column("y").to_pylist(), int)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    aside = np.array([zlib.crc32(f"aside {ids[i]}".encode()) % 5 == 0 for i in order], bool)
    numbers, slots = words.column("numbers").combine_chunks(), words.column("slots").combine_chunks()
    made = [(numbers[i].values.to_numpy(), slots[i].values.to_numpy().reshape(1 + len(PREFIXES), -1)) for i in order]
    return fit(made, y[order], live, aside)


def _score(batches, model: Model, text_at: int):
    for batch in batches:
        texts = [t or b"" for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
        n = len(texts)
        score, count, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        worst, at, to = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i, j in _chunks(texts):
            s = sentences(texts[i:j])
            z = model.sentence_logits(s)
            score[i:j] = model.document_scores(z, s.first_sentence)
            some = np.flatnonzero(np.diff(s.first_sentence))
            if len(some):
                first = s.first_sentence[some]
                n_own = np.diff(s.first_sentence)[some]
                top_z = np.maximum.reduceat(z, first)
                number = np.arange(len(z))
                top = np.minimum.reduceat(np.where(z >= np.repeat(top_z, n_own), number, len(z)), first)
                count[i + some], bad[i + some] = n_own, np.add.reduceat((z >= 0).astype(np.int64), first)
                worst[i + some], at[i + some], to[i + some] = 1 / (1 + np.exp(-top_z)), s.start[top], s.end[top]
        made = {"score": score, "predicted": (score >= 0.5).astype(np.int32), "n_sentences": count, "n_offending": bad, "worst_score": worst, "worst_start": at, "worst_end": to}
        taken = {f"{MADE}{k}": pa.array(v) for k, v in made.items()}
        yield pa.RecordBatch.from_arrays([*batch.columns, *taken.values()], names=[*batch.schema.names, *taken])


MADE = "tox_"


def score_documents(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``df`` with ``tox_score, tox_predicted, tox_n_sentences, tox_n_offending`` and the worst sentence.

    ``tox_worst_start, tox_worst_end`` are byte offsets in the text, ``tox_worst_score`` that sentence's score. Null and
    empty texts have the score 0. Of sentences that score alike the first is the worst. Columns of ``df`` with these
    names are replaced, others stay; rows are neither lost nor merged, repeated ones score alike, an empty table stays
    empty. Texts of any length are scored whole.
    """
    made = [("score", "double"), ("predicted", "int"), ("n_sentences", "long"), ("n_offending", "long"), ("worst_score", "double"), ("worst_start", "long"), ("worst_end", "long")]
    df = df.drop(*[f"{MADE}{k}" for k, _ in made])
    types = {"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{MADE}{k}", types[kind]) for k, kind in made)])
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda batches: _score(batches, model, at), schema)
