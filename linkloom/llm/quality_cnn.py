"""Operator 2: quality classifier, a byte-level convolutional network.

Bytes are embedded; learned filters of 16 bytes step over the text by 8, so
that each filter's places overlap by half. Chunks of 512 bytes, overlapping
by half too, cover the whole document; a filter's largest value in a chunk
is kept (max-pooling), and a chunk's evidence is a weighted sum of these.
The document's probability is the logistic function of its chunks' mean
evidence, so that length alone says nothing.

Training is numpy on the driver over a bounded sample of labelled rows (at
most ``SAMPLE`` documents of at most ``SAMPLE_BYTES`` bytes each); scoring
is one pass over the table, without a shuffle, whole texts always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import slices, with_python

#: Labelled documents to fit on, and the longest of them in bytes.
SAMPLE, SAMPLE_BYTES = 2500, 16_384
STEP, DIM, FILTERS = 8, 8, 32
#: Filter places in half a chunk.
HALF = 32
PAD = 256


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes laid out so that each row begins a half chunk, padded; each row's halves."""
    halves = np.maximum(1, -(-np.diff(offsets) // (HALF * STEP)))
    begin = np.concatenate([[0], np.cumsum(halves)]) * (HALF * STEP)
    laid = np.full(begin[-1], PAD, np.uint16)
    shift = np.repeat(begin[:-1] - offsets[:-1], np.diff(offsets))
    laid[np.arange(len(data)) + shift] = data
    return laid, halves


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First half of every chunk, its last half, and each row's chunks."""
    begin = np.concatenate([[0], np.cumsum(halves)])
    count = np.maximum(1, halves - 1)
    row = np.repeat(np.arange(len(halves)), count)
    nth = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    first = begin[row] + nth
    return first, np.minimum(first + 1, begin[row + 1] - 1), count


class Model:
    """Weights; ``fit`` learns them, ``score`` applies them."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.5, (257, DIM)).astype(np.float32)
        self.emb[PAD] = 0
        self.w = rng.normal(0, 0.15, (2 * STEP * DIM, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def places(self, laid: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
        """Every filter's value at every place; a place is this step's bytes and the next's.

        ``begins``: steps with which another row begins; they are no part of the place before.
        """
        x = self.emb[laid].reshape(-1, STEP * DIM)
        z = x @ np.hstack([self.w[:STEP * DIM], self.w[STEP * DIM:]])
        if begins is not None:
            z[begins, FILTERS:] = 0
        out = z[:, :FILTERS]
        out[:-1] += z[1:, FILTERS:]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        laid, halves = _layout(data, offsets)
        pooled = np.empty((len(laid) // (HALF * STEP), FILTERS), np.float32)
        row_begins = np.cumsum(halves) * HALF
        per = 1024  # halves looked at together, and one more step for the last place's second half
        for at in range(0, len(pooled), per):
            to = min(len(pooled), at + per)
            part = laid[at * HALF * STEP:to * HALF * STEP + STEP]
            if to == len(pooled):
                part = np.concatenate([part, np.full(STEP, PAD, np.uint16)])
            inside = row_begins[np.searchsorted(row_begins, at * HALF):np.searchsorted(row_begins, to * HALF, "right")] - at * HALF
            pooled[at:to] = self.places(part, inside)[:-1].reshape(to - at, HALF, FILTERS).max(1)
        first, last, count = _chunks(halves)
        seen = np.maximum(np.maximum(pooled[first], pooled[last]) + self.b, 0)
        evidence = seen @ self.v + self.c[0]
        mean = np.add.reduceat(evidence.astype(np.float64), np.concatenate([[0], np.cumsum(count)[:-1]])) / count
        return 1 / (1 + np.exp(-np.clip(mean, -30, 30)))

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 6, batch: int = 96, rate: float = 4e-3, seed: int = 11) -> Model:
        y_of = np.array(labels, np.float32)
        share = float(np.clip(y_of.mean() if len(y_of) else 0.5, 0.01, 0.99))
        self.c[0] = np.log(share / (1 - share))
        if len(set(labels)) < 2:  # nothing to tell apart: the score is the prior
            self.v[:] = 0
            return self
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        laid, halves = _layout(np.frombuffer(b"".join(texts), np.uint8), offsets)
        first, last, count = _chunks(halves)
        y = np.repeat(y_of, count)
        weight = np.repeat((1 / count).astype(np.float32), count)  # documents count alike
        weight /= weight.mean()
        laid = np.concatenate([laid, np.full(HALF * STEP, PAD, np.uint16)])
        size = HALF * STEP
        rng = np.random.default_rng(seed)
        params = [self.emb, self.w, self.b, self.v, self.c]
        m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            order = rng.permutation(len(first))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                n = len(pick)
                # A chunk's bytes, with a step of padding for its last place.
                raw = np.full((n, 2 * size + STEP), PAD, np.uint16)
                raw[:, :size] = laid[first[pick][:, None] * size + np.arange(size)]
                two = last[pick] > first[pick]
                raw[two, size:2 * size] = laid[last[pick][two][:, None] * size + np.arange(size)]
                place = self.places(raw.ravel()).reshape(n, -1, FILTERS)[:, :2 * HALF]
                top = place.argmax(1)
                value = np.take_along_axis(place, top[:, None], 1)[:, 0] + self.b
                seen = np.maximum(value, 0)
                p = 1 / (1 + np.exp(-np.clip(seen @ self.v + self.c[0], -30, 30)))
                d = ((p - y[pick]) * weight[pick] / n).astype(np.float32)
                back = d[:, None] * self.v * (value > 0)
                window = raw[np.arange(n)[:, None, None], (top * STEP)[:, :, None] + np.arange(2 * STEP)]
                x = self.emb[window]
                grad_w = np.einsum("nf,nfk->kf", back, x.reshape(n, FILTERS, -1))
                to_x = (back[:, :, None] * self.w.T).reshape(-1, DIM)
                grad_emb = np.stack([np.bincount(window.ravel(), to_x[:, j], 257) for j in range(DIM)], 1).astype(np.float32)
                grad_emb[PAD] = 0
                grads = [grad_emb, grad_w, back.sum(0), seen.T @ d + 1e-4 * self.v, d.sum(keepdims=True)]
                step += 1
                for i, (q, g) in enumerate(zip(params, grads)):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    s[i] = 0.999 * s[i] + 0.001 * g * g
                    q -= (rate * (0.7 ** epoch) * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def is_held_out(id_col: str):
    """Every third document by the crc32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample: int = SAMPLE) -> Model:
    """A model learned from ``labels`` of documents that are not held out.

    The sample is the same however the tables are partitioned: the first
    ``sample`` by hash of the id. Null labels and ids are left out, of
    repeated labels the smallest counts, null text is empty. Without two
    kinds of labels every score is the labels' mean (0.5 without labels).
    """
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~is_held_out(id_col))
             .groupBy(id_col).agg(F.min(label_col).alias("_label")))
    # Twice the sample, as some labelled documents are too long or missing; a bounded table.
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(2 * sample)
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).filter(F.octet_length("_text") <= SAMPLE_BYTES)
    rows = (texts.join(F.broadcast(picked), id_col).groupBy(id_col).agg(F.min(F.struct("_label", "_text")).alias("x"))
            .orderBy(F.xxhash64(id_col), id_col).limit(sample).select("x.*").collect())
    return Model().fit([r[1].encode() for r in rows], [r[0] for r in rows])


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "_text"):
            score = np.round(model.score(data, offsets), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"))
    out = with_python(rows).mapInArrow(scored, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, all columns as they are."""
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, text_col):
            yield batch.filter(pa.array(np.round(model.score(data, offsets), 6) >= 0.5))

    return with_python(docs).mapInArrow(kept, docs.schema)
