"""Operator 5, toxicity: a convolutional text classifier trained in numpy.

A word is the sum of four hashed embeddings (the word and its first 4, 5 and 6 bytes, so
that inflected forms share evidence).  Filters of width 1, 2 and 3 run over the whole
text, each is max-pooled, and a logistic layer gives the logit.  The embeddings start
with smoothed log-odds of the training documents and all layers are trained with Adam;
the gradient of a max pool touches only the winning window.  One part of the training
rows is kept from training and sets a decision threshold for each language, which is
guessed from the text's own function words; a score is the logistic of the logit less that
threshold, so 0.5 is the threshold everywhere.

The model is fitted on a bounded sample of labelled rows (``TRAIN_ROWS`` of each class,
in the order of a hash of doc_id, texts up to ``TRAIN_CHARS``); held-out rows never enter
it.  Scoring covers every row and whole texts, in the tasks, with no shuffle.  Of labels,
lang, source and doc_id nothing enters a score.

Defined results: a null or empty text is scored as a text without words; very long texts are
scored whole, by parts; repeated rows score alike; a score of exactly 0.5 is predicted 1; a doc_id with several labels counts as toxic if one says so, null labels are
ignored; without labelled rows of both classes every score is the share of toxic rows (0
without any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_buffer, word_hashes, words

TRAIN_ROWS = 2500
TRAIN_CHARS = 20_000
BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PREFIXES = (0, 4, 5, 6)  # 0: the whole word
EPOCHS = 4
BATCH = 64
PAD = max(WIDTHS) - 1
#: characters of text that a task handles at once
PIECE = 200_000

#: function words that tell the languages apart (fixed values)
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with on at by from this are it as be not",
    "de": "der die das und ist nicht ein zu den mit von im für auf dem sich des eine auch werden",
    "fr": "le la les et des est que une dans pour qui sur pas au du il elle avec ce par",
    "es": "el los las y en una por para con del se lo su al como más pero no es un",
}
LANGUAGES = tuple(FUNCTION_WORDS)

#: bytes of words: ASCII letters and digits, and all of other scripts
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers ``[words + pads, 4]`` of all texts and the first row of each text.

    Each text is followed by ``PAD`` rows of the zero bucket, so no window sees two texts.
    """
    data, offsets = text_buffer(pa.array([(t or "").lower() for t in texts], pa.large_string()))
    start, end, row = words(data, offsets, _NOT_WORD)
    counts = np.bincount(row, minlength=len(texts))
    first = np.cumsum(counts + PAD) - counts - PAD
    at = np.arange(len(start)) + PAD * row
    out = np.zeros((len(start) + PAD * len(texts), len(PREFIXES)), np.int64)
    for j, k in enumerate(PREFIXES):
        h = word_hashes(data, start, np.minimum(end, start + k) if k else end)
        out[at, j] = 1 + (mix(h + np.uint64(j)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    return out, first


def language_table() -> np.ndarray:
    """Language number of each function word's bucket, -1 elsewhere."""
    table = np.full(BUCKETS, -1, np.int8)
    for k, group in enumerate(FUNCTION_WORDS.values()):
        table[tokens([group])[0][:-PAD, 0]] = k
    return table


def languages(token: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Language guess of each text: most function words (ties and none: the first)."""
    hit = table[token[:, 0]]
    text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(token))))
    counts = np.zeros((len(first), len(LANGUAGES)))
    np.add.at(counts, (text[hit >= 0], hit[hit >= 0]), 1)
    return counts.argmax(1)


class ConvText:
    """Weights, forward pass and training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.embedding = np.zeros((BUCKETS, DIM), np.float32)
        self.kernel = [(0.3 * r.standard_normal((k, DIM, FILTERS))).astype(np.float32) for k in WIDTHS]
        for w in self.kernel:  # half of the filters start out looking for toxic evidence
            w[0, 0, : FILTERS // 2] = 0.5 + 0.1 * r.random(FILTERS // 2)
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (0.3 * r.random(FILTERS * len(WIDTHS))).astype(np.float32)
        self.offset = np.float32(-1)
        self.threshold = np.zeros(len(LANGUAGES), np.float32)
        self.constant: float | None = None

    def start(self, docs: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> None:
        """Embeddings from smoothed log-odds of document frequencies."""
        count = np.zeros((2, BUCKETS))
        for d, y in zip(docs, toxic, strict=True):
            count[int(y), np.unique(d)] += 1
        share = (count + 2) / (np.array([[len(toxic) - toxic.sum()], [toxic.sum()]]) + 4)
        r = np.random.default_rng(seed)
        self.embedding[:] = 0.01 * r.standard_normal(self.embedding.shape)
        odds = np.log(share[1] / share[0])
        odds[count.sum(0) == 0] = 0
        self.embedding[:, 0] = np.clip(odds - np.log((len(toxic) - toxic.sum() + 4) / (toxic.sum() + 4)) * (count.sum(0) == 0), -2, 4)
        self.embedding[0] = 0

    def windows(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.embedding[token[:, 0]]
        for j in range(1, token.shape[1]):
            x = x + self.embedding[token[:, j]]
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for i, (k, w) in enumerate(zip(WIDTHS, self.kernel, strict=True)):
            part = x @ w[0]
            for o in range(1, k):
                part[:-o] += x[o:] @ w[o]
            out[:, i * FILTERS:(i + 1) * FILTERS] = part
        return x, out

    def logits(self, token: np.ndarray, first: np.ndarray) -> np.ndarray:
        _, conv = self.windows(token)
        return np.maximum(np.maximum.reduceat(conv, first, axis=0) + self.bias, 0) @ self.out + self.offset

    def train(self, docs: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        dense = [*self.kernel, self.bias, self.out]
        first_m, second_m, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
        weight = np.where(toxic == 1, 0.5 / max(toxic.mean(), 1e-6), 0.5 / max(1 - toxic.mean(), 1e-6))
        for _ in range(EPOCHS):
            for ids in np.array_split(r.permutation(len(docs)), max(1, len(docs) // BATCH)):
                own = [docs[i] for i in ids]
                token = np.concatenate(own)
                size = np.array([len(d) for d in own])
                first = np.cumsum(size) - size
                x, conv = self.windows(token)
                top = np.maximum.reduceat(conv, first, axis=0)
                at = np.arange(len(token))[:, None] + np.zeros((1, conv.shape[1]), np.int64)
                at[conv != np.repeat(top, size, axis=0)] = len(token)
                winner = np.minimum.reduceat(at, first, axis=0)
                hidden = np.maximum(top + self.bias, 0)
                z = hidden @ self.out + self.offset
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[ids]) * weight[ids] / len(ids)).astype(np.float32)
                d_hidden = g[:, None] * self.out * (hidden > 0)
                grads = [np.zeros_like(w) for w in self.kernel] + [d_hidden.sum(0), g @ hidden]
                for i, k in enumerate(WIDTHS):
                    cols = slice(i * FILTERS, (i + 1) * FILTERS)
                    for o in range(k):
                        place = np.minimum(winner[:, cols] + o, len(token) - 1)
                        grads[i][o] = np.einsum("df,dfe->ef", d_hidden[:, cols], x[place])
                        d_x = d_hidden[:, cols, None] * self.kernel[i][o].T[None]
                        for j in range(token.shape[1]):
                            rows = token[place, j]
                            np.add.at(self.embedding, rows[rows > 0], -0.5 * d_x[rows > 0])
                step += 1
                for p, d, m, v in zip(dense, grads, first_m, second_m, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.offset -= np.float32(0.05 * g.sum())

    def calibrate(self, logit: np.ndarray, toxic: np.ndarray, lang: np.ndarray) -> None:
        """Threshold of each language with the most balanced accuracy, drawn towards the pooled one."""
        pooled = _best_threshold(logit, toxic)
        for k in range(len(LANGUAGES)):
            own = lang == k
            few = min(toxic[own].sum(), (1 - toxic[own]).sum())
            share = few / (few + 10)
            self.threshold[k] = pooled if not few else share * _best_threshold(logit[own], toxic[own]) + (1 - share) * pooled

    def score(self, texts: list[str | None], table: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        token, first = tokens(texts)
        z = self.logits(token, first) - self.threshold[languages(token, first, table)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def _best_threshold(logit: np.ndarray, toxic: np.ndarray) -> float:
    order = np.argsort(logit)
    z, y = logit[order].astype(float), toxic[order]
    if not y.sum() or y.sum() == len(y):
        return 0.0
    right = np.append(0, np.cumsum(1 - y)) + y.sum() - np.append(0, np.cumsum(y))
    best = np.flatnonzero(right == right.max())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS):
    """At most ``rows`` labelled documents of each class: texts and labels, in a fixed order.

    The ids are drawn from the labels first; they are at most ``2 * rows``, so they can be
    broadcast to the documents.
    """
    marked = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.md5(F.col("doc_id").cast("string"))))
    picked = [marked.where(F.col("toxic") == y).orderBy("turn", "doc_id").limit(rows) for y in (1, 0)]
    ids = picked[0].unionByName(picked[1])
    found = (docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(ids), "doc_id")
             .groupBy("doc_id", "turn", "toxic").agg(F.min("text").alias("text")).toPandas().sort_values(["turn", "doc_id"]))
    return found["text"].tolist(), found["toxic"].to_numpy(np.int64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ConvText:
    texts, toxic = training_rows(docs, labels, rows)
    model = ConvText()
    if not toxic.sum() or toxic.sum() == len(toxic):
        model.constant = float(toxic.mean()) if len(toxic) else 0.0
        return model
    each: list[np.ndarray] = []
    for a in range(0, len(texts), 100):  # keeps the driver's arrays small
        token, first = tokens(texts[a:a + 100])
        each += [t.astype(np.int32) for t in np.split(token, first[1:])]
    check = np.arange(len(texts)) % 5 == 4
    if min(toxic[check].sum(), (1 - toxic[check]).sum(), toxic[~check].sum()) < 2:
        check[:] = False
    own = [d for d, c in zip(each, check, strict=True) if not c]
    model.start(own, toxic[~check])
    model.train(own, toxic[~check])
    judged = check if check.any() else ~check
    kept = [d for d, c in zip(each, judged, strict=True) if c]
    logit, lang, table = [], [], language_table()
    for a in range(0, len(kept), 100):
        part = kept[a:a + 100]
        size = np.array([len(d) for d in part])
        token, first = np.concatenate(part), np.cumsum(size) - size
        logit.append(model.logits(token, first))
        lang.append(languages(token, first, table))
    model.calibrate(np.concatenate(logit), toxic[judged], np.concatenate(lang))
    return model


def score(docs: DataFrame, model: ConvText, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text in ``out``; no shuffle."""
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)])
    held = docs.sparkSession.sparkContext.broadcast((model, language_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = held.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores, at, total = [np.zeros(0)], 0, 0
            for i, t in enumerate(texts):
                total += len(t or "")
                if total >= PIECE or i + 1 == len(texts):
                    scores.append(model.score(texts[at:i + 1], table))
                    at, total = i + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    return (score(docs.select("doc_id", "text"), model)
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    model = fit(docs, labels)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, model, out=name).where(F.col(name) < 0.5).drop(name)
