"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read UTF-8 bytes; at every position their states give language probabilities, which are pooled over
the document. Training is backpropagation through time in numpy on a bounded sample of labelled documents. Texts are
read whole, in segments that the network takes side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shingles import row_chunks, text_bytes
from .staging import ready

HIDDEN = 8
#: Bytes of one segment when predicting; a position sees at most the rest of its segment on either side.
SEGMENT = 256
#: Documents per language, and bytes of each, that the network is trained on at most.
TRAIN_DOCS, TRAIN_BYTES = 600, 1024
TRAIN_SEGMENT, TRAIN_BATCH, TRAIN_STEPS, LEARNING_RATE = 64, 256, 400, 0.02
_WIDE = 2048


@dataclass
class Direction:
    """Weights of one direction: tables by byte (256 x H) and recurrent matrices (H x H) of update, reset, candidate."""

    tables: list[np.ndarray]
    matrices: list[np.ndarray]
    output: np.ndarray  # H x languages


@dataclass
class Model:
    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray


def _cells(d: Direction, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Logit parts (steps, languages, width) of one direction over ``data`` (steps, width), read from the top.

    Gates are hard sigmoids and the candidate a hard tanh, so a step is additions, products and limits.
    """
    steps, width = data.shape
    hidden = d.matrices[0].shape[0]
    tables = [np.ascontiguousarray(t.T) for t in d.tables]
    weights = [np.ascontiguousarray(m.T) for m in d.matrices]
    out_t = np.ascontiguousarray(d.output.T)
    h = np.zeros((hidden, width), np.float32)
    logits = np.empty((steps, d.output.shape[1], width), np.float32)
    trace = []
    for t in range(steps):
        at = data[t]
        zx, rx, cx = (np.take(x, at, axis=1) for x in tables)
        zx += weights[0] @ h
        rx += weights[1] @ h
        if keep:
            z_raw, r_raw = zx.copy(), rx.copy()
        np.clip(zx, 0.0, 1.0, out=zx)
        np.clip(rx, 0.0, 1.0, out=rx)
        u = weights[2] @ h
        cx += rx * u
        if keep:
            c_raw = cx.copy()
        np.clip(cx, -1.0, 1.0, out=cx)
        if keep:
            trace.append((h, zx, rx, cx, u, z_raw, r_raw, c_raw))
        cx_h = cx - h
        cx_h *= zx
        h = h + cx_h
        np.matmul(out_t, h, out=logits[t])
    return logits, trace


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits = logits - logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def _gradients(d: Direction, data: np.ndarray, trace: list, g_logits: np.ndarray) -> list[np.ndarray]:
    """Gradients of tables, matrices and output, backwards through time."""
    hidden = d.matrices[0].shape[0]
    g_tables = [np.zeros_like(t) for t in d.tables]
    g_matrices = [np.zeros_like(m) for m in d.matrices]
    g_out = np.zeros_like(d.output)
    g_h = np.zeros((hidden, data.shape[1]), np.float32)
    for t in range(len(trace) - 1, -1, -1):
        h, z, r, c, u, z_raw, r_raw, c_raw = trace[t]
        now = h + z * (c - h)
        g_out += now @ g_logits[t].T
        g_h = g_h + d.output @ g_logits[t]
        g_z = g_h * (c - h) * ((z_raw > 0) & (z_raw < 1))
        g_c = g_h * z * (np.abs(c_raw) < 1)
        g_r = g_c * u * ((r_raw > 0) & (r_raw < 1))
        g_u = g_c * r
        for k, g in enumerate((g_z, g_r, g_c)):
            np.add.at(g_tables[k], data[t], g.T)
        g_matrices[0] += h @ g_z.T
        g_matrices[1] += h @ g_r.T
        g_matrices[2] += h @ g_u.T
        g_h = g_h * (1 - z) + d.matrices[0] @ g_z + d.matrices[1] @ g_r + d.matrices[2] @ g_u
    return [*g_tables, *g_matrices, g_out]


def train(texts: list[bytes], labels: list[str], steps: int = TRAIN_STEPS, seed: int = 7) -> Model:
    """A network for the distinct ``labels`` (sorted), trained on segments drawn from ``texts``."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)

    def direction() -> Direction:
        tables = [rng.normal(b, 0.2, (256, HIDDEN)).astype(np.float32) for b in (0.3, 0.7, 0.0)]
        return Direction(tables, [rng.normal(0, 0.2, (HIDDEN, HIDDEN)).astype(np.float32) for _ in range(3)], rng.normal(0, 0.3, (HIDDEN, len(languages))).astype(np.float32))

    model = Model(languages, direction(), direction(), np.zeros(len(languages), np.float32))
    usable = [(t, languages.index(y)) for t, y in zip(texts, labels) if t]
    if len(languages) < 2 or not usable:
        return model
    by_language = [[t for t, y in usable if y == k] for k in range(len(languages))]
    by_language = [(k, group) for k, group in enumerate(by_language) if group]
    flat = [*model.forward.tables, *model.forward.matrices, model.forward.output, *model.backward.tables, *model.backward.matrices, model.backward.output, model.bias]
    first, second = [np.zeros_like(p) for p in flat], [np.zeros_like(p) for p in flat]
    for step in range(1, steps + 1):
        data, y = np.full((TRAIN_SEGMENT, TRAIN_BATCH), 32, np.uint8), np.empty(TRAIN_BATCH, int)
        for b in range(TRAIN_BATCH):
            y[b], group = by_language[b % len(by_language)]
            text = group[rng.integers(len(group))]
            at = rng.integers(max(1, len(text) - TRAIN_SEGMENT + 1))
            piece = np.frombuffer(text[at : at + TRAIN_SEGMENT], np.uint8)
            data[: len(piece), b] = piece
        ahead, trace_f = _cells(model.forward, data, True)
        back, trace_b = _cells(model.backward, data[::-1], True)
        p = _softmax(ahead + back[::-1] + model.bias[:, None])
        p[:, y, np.arange(TRAIN_BATCH)] -= 1.0
        p /= TRAIN_SEGMENT * TRAIN_BATCH
        grads = [*_gradients(model.forward, data, trace_f, p), *_gradients(model.backward, data[::-1], trace_b, p[::-1]), p.sum((0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = LEARNING_RATE * min(1.0, 2.0 * (1.0 - step / (steps + 1)))
        for q, g, m, v in zip(flat, grads, first, second):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (rows x languages) over all positions of each row; zeros for an empty row."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    if not model.languages:
        return np.zeros((n, 1))
    pieces = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(n), pieces)
    begin = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    size = np.minimum(offsets[1:][row] - begin, SEGMENT)
    total = np.zeros((n, len(model.languages)))
    order = np.argsort(-size, kind="stable")  # like lengths side by side
    for lo in range(0, len(order), _WIDE):
        pick = order[lo : lo + _WIDE]
        steps = int(size[pick].max())
        at = begin[pick][None, :] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < size[pick][None, :]
        block = np.where(inside, data[np.minimum(at, len(data) - 1)], np.uint8(32))
        ahead, _ = _cells(model.forward, block, False)
        back, _ = _cells(model.backward, block[::-1], False)
        p = _softmax(ahead + back[::-1] + model.bias[:, None])
        np.add.at(total, row[pick], np.einsum("tkw,tw->wk", p, inside.astype(np.float32), optimize=True))
    return total / np.maximum(lengths, 1)[:, None]


def position_labels(model: Model, text: str) -> list[str]:
    """The likeliest language at every byte of ``text``."""
    data = np.frombuffer(text.encode(), np.uint8)
    out: list[str] = []
    for lo in range(0, len(data), SEGMENT):
        block = data[lo : lo + SEGMENT][:, None]
        logits = _cells(model.forward, block, False)[0] + _cells(model.backward, block[::-1], False)[0][::-1] + model.bias[:, None]
        out += [model.languages[k] for k in logits[:, :, 0].argmax(1)]
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> Model:
    """A network from ``text`` and ``lang`` of at most ``train_docs`` different texts per language.

    The texts with the smallest hashes are taken, each once however often it occurs, and of each a piece of
    ``train_bytes`` characters at a place that the hash decides. Rows without language or letters teach nothing, nor
    does an empty table; other columns are not read.
    """
    ready(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    at = F.pmod(F.col("h"), F.greatest(F.length("text") - train_bytes, F.lit(1))) + 1
    pieces = hashed.select("lang", "h", F.substr("text", at.cast("int"), F.lit(train_bytes)).alias("piece"))
    # ranked first in 64 parts, so that the hashes of a common language never meet in one task
    rank = lambda *keys: F.row_number().over(Window.partitionBy("lang", *keys).orderBy("h"))
    texts = hashed.select("lang", "h").distinct().withColumn("part", F.pmod("h", F.lit(64)))
    texts = texts.withColumn("rank", rank("part")).where(F.col("rank") <= train_docs).withColumn("rank", rank()).where(F.col("rank") <= train_docs)
    sample = pieces.join(texts.select("lang", "h", "rank"), ["lang", "h"]).groupBy("lang", "rank").agg(F.min("piece").alias("piece"))
    rows = sample.orderBy("lang", "rank").select("lang", "piece").collect()
    return train([r[1].encode() for r in rows], [r[0] for r in rows])


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from ``text`` alone.

    ``und`` with score 0 for texts that are null or have no letter, and where the model knows no language; else the
    language of the highest pooled probability (the first by name of equal ones) and that probability. Repeated
    rows each get a row, an empty table gives none; other columns are not read. No shuffle.
    """
    ready(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            shares = [pooled(model, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in row_chunks(offsets)]
            share = np.concatenate(shares) if shares else np.zeros((0, max(1, len(model.languages))))
            best = share.argmax(1)
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.languages[b] if k else "und" for b, k in zip(best.tolist(), known)], pa.string()),
                 pa.array(np.where(known, np.minimum(share[np.arange(len(best)), best], 1.0), 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.languages))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
