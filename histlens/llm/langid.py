"""Language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent layer reads a text's UTF-8 bytes forwards and another backwards; a softmax over both states labels every
byte, and a document's probabilities are the mean over all its bytes. Texts run in pieces of ``SEGMENT`` bytes side by side, each read with
``CONTEXT`` bytes of the text before and after it, whose labels its neighbours give: so a byte's label doesn't depend on where a
piece begins, but for what the network remembers over more than ``CONTEXT`` bytes.

Trained in numpy by backpropagation through time (Adam, cross entropy at every byte) on a bounded sample of labelled rows: at most
``SAMPLE_ROWS`` rows of every language, by order of a hash, with their whole texts. Prediction reads whole texts.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned from. The
classes are all labels that occur, in order of code points. Rows are independent, so repeated rows get equal results; an empty table gives
none. Memory follows the longest text of a batch, on the driver the sample. Labels, sources and ids don't enter a prediction. ``accepted``
passes all columns through, whatever their names; the others ignore further ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 600
SEGMENT, CONTEXT, TRAINED, HIDDEN, BATCH, STEPS = 96, 24, 64, 8, 160, 350
LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass
class Model:
    """Weights of both directions, stacked: x[2, 257, 3H] (input and bias by byte; 256 pads), u[2, H, 3H], c[2, H]; out[2H, L], bias[L]."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.out, self.bias]


def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    return Model(langs, draw(2, 257, 3 * hidden), draw(2, hidden, 3 * hidden), np.zeros((2, hidden), np.float32), draw(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """In place."""
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def states(m: Model, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(T, B, 2H) states for ``seq`` (T, B) of bytes; both directions advance in one step. ``keep`` gets what backward() needs."""
    steps, batch = seq.shape
    hid = m.u.shape[1]
    out = np.empty((steps, batch, 2 * hid), np.float32)
    h = np.zeros((2, batch, hid), np.float32)
    for t in range(steps):
        a = np.stack((m.x[0][seq[t]], m.x[1][seq[steps - 1 - t]]))
        g = np.matmul(h, m.u)
        zr = a[:, :, : 2 * hid]
        zr += g[:, :, : 2 * hid]
        zr = _sigmoid(zr)
        z, r = zr[:, :, :hid], zr[:, :, hid:]
        inner = g[:, :, 2 * hid :]
        inner += m.c[:, None]
        n = np.tanh(a[:, :, 2 * hid :] + r * inner)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, z.copy(), r.copy(), inner.copy(), n))
        h = new
        out[t, :, :hid], out[steps - 1 - t, :, hid:] = h[0], h[1]
    return out


def probabilities(m: Model, hs: np.ndarray) -> np.ndarray:
    p = hs.reshape(-1, hs.shape[2]) @ m.out
    p += m.bias
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p.reshape(*hs.shape[:2], -1)


def pooled(m: Model, seq: np.ndarray, context: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(B, L) sums over the bytes of ``seq`` (T, B) of each byte's probabilities, and the number of bytes; the first and last ``context``
    places are read, but not counted.

    The same network as states() and probabilities(), laid out with features before the batch so that all steps run over
    long contiguous rows.
    """
    steps, batch = seq.shape
    hid = m.u.shape[1]
    table = np.ascontiguousarray(m.x.transpose(0, 2, 1))
    ut = np.ascontiguousarray(m.u.transpose(0, 2, 1))
    hs = np.empty((2, steps, hid, batch), np.float32)
    h, a, g = np.zeros((2, hid, batch), np.float32), np.empty((2, 3 * hid, batch), np.float32), np.empty((2, 3 * hid, batch), np.float32)
    c = m.c[:, :, None]
    for t in range(steps):
        np.take(table[0], seq[t], axis=1, out=a[0], mode="clip")
        np.take(table[1], seq[steps - 1 - t], axis=1, out=a[1], mode="clip")
        np.matmul(ut, h, out=g)
        zr = a[:, : 2 * hid]
        zr += g[:, : 2 * hid]
        zr = _sigmoid(zr)
        n = g[:, 2 * hid :]
        n += c
        n *= zr[:, hid:]
        n += a[:, 2 * hid :]
        np.tanh(n, out=n)
        h -= n
        h *= zr[:, :hid]
        h += n
        hs[0, t], hs[1, steps - 1 - t] = h[0], h[1]
    total = np.zeros((len(m.bias), batch), np.float32)
    wf, wb = np.ascontiguousarray(m.out[:hid].T), np.ascontiguousarray(m.out[hid:].T)
    for t in range(context, steps - context):
        p = wf @ hs[0, t]
        p += wb @ hs[1, t]
        p += m.bias[:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        scale = p.sum(0)
        np.divide(seq[t] < 256, scale, out=scale)
        p *= scale
        total += p
    return total.T, (seq[context : steps - context] < 256).sum(0)


def backward(m: Model, seq: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients, by backpropagation through time; bytes of 256 (padding) don't count."""
    steps, batch = seq.shape
    hid = m.u.shape[1]
    kept: list = []
    hs = states(m, seq, kept)
    p = probabilities(m, hs)
    real = (seq < 256)[:, :, None]
    count = max(1, int(real.sum()))
    rows = np.arange(batch)
    loss = float(-(np.log(p[:, rows, labels] + 1e-9) * real[:, :, 0]).sum() / count)
    d = p
    d[:, rows, labels] -= 1
    d *= real / count
    flat = d.reshape(-1, d.shape[2])
    g_out, g_bias, dh_all = hs.reshape(-1, 2 * hid).T @ flat, flat.sum(0), d @ m.out.T
    g_x, g_u, g_c = np.zeros_like(m.x), np.zeros_like(m.u), np.zeros_like(m.c)
    dh = np.zeros((2, batch, hid), np.float32)
    ut = m.u.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, z, r, inner, n = kept[t]
        dh = dh + np.stack((dh_all[t, :, :hid], dh_all[steps - 1 - t, :, hid:]))
        da_n = dh * (1 - z) * (1 - n * n)
        da_z = dh * (h - n) * z * (1 - z)
        da_r = da_n * inner * r * (1 - r)
        d_inner = da_n * r
        dg = np.concatenate((da_z, da_r, d_inner), 2)
        da = np.concatenate((da_z, da_r, da_n), 2)
        for k, s in ((0, seq[t]), (1, seq[steps - 1 - t])):
            np.add.at(g_x[k], s, da[k])
        g_u += np.matmul(h.transpose(0, 2, 1), dg)
        g_c += d_inner.sum(1)
        dh = dh * z + np.matmul(dg, ut)
    return loss, [g_x, g_u, g_c, g_out, g_bias]


def cut(data: bytes, size: int, context: int = 0) -> np.ndarray:
    """(n, size + 2 * context) bytes: pieces of ``size`` bytes and what stands around them, padded with 256."""
    n = -(-len(data) // size)
    out = np.full(n * size + 2 * context, 256, np.int16)
    out[context : context + len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(out, size + 2 * context)[::size] if n else np.zeros((0, size + 2 * context), np.int16)


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 5) -> Model:
    """Every language has an equal share of a batch."""
    names = sorted(set(langs))
    m = fresh(names, seed=seed)
    pools = [np.concatenate([cut(t.encode(), TRAINED) for t, x in zip(texts, langs, strict=True) if x == name]) for name in names]
    rng, share = np.random.default_rng(seed), max(1, BATCH // len(names))
    labels = np.repeat(np.arange(len(names)), share)
    first, second = [np.zeros_like(p) for p in m.params()], [np.zeros_like(p) for p in m.params()]
    for step in range(1, steps + 1):
        seq = np.concatenate([pool[rng.integers(0, len(pool), share)] for pool in pools]).T
        _, grads = backward(m, seq, labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * (1 - step / (steps + 1))
        for p, g, a, b in zip(m.params(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def predict(m: Model, texts: list[str | None], width: int = 2048) -> list[tuple[str, float]]:
    """(language, mean probability) of each whole text."""
    out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
    if not m.langs:
        return out
    todo = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    sums, sizes = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def run() -> None:
        seqs, own = np.concatenate(held), np.concatenate(owner)
        for a in range(0, len(seqs), width):
            seq = np.ascontiguousarray(seqs[a : a + width].T)
            total, count = pooled(m, seq, CONTEXT)
            np.add.at(sums, own[a : a + width], total)
            np.add.at(sizes, own[a : a + width], count)
        held.clear()
        owner.clear()

    size = 0
    for i in todo:
        held.append(cut(texts[i].encode(), SEGMENT, CONTEXT))
        owner.append(np.full(len(held[-1]), i))
        size += len(held[-1])
        if size >= 4 * width:
            run()
            size = 0
    if held:
        run()
    for i in todo:
        best = int(sums[i].argmax())
        out[i] = (m.langs[best], float(min(1.0, sums[i, best] / sizes[i])))
    return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """From ``docs(doc_id, text, lang)``: ``rows`` rows of every language at most go to the driver, however common it is."""
    known = docs.where(F.col("lang").isNotNull() & (F.col("text") != ""))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fresh([])
    h = F.xxhash64("doc_id", "lang")
    # half as many again by hash, so that what is ordered stays small and still holds enough
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * rows / n))))
    some = known.select("lang", "text", h.alias("h")).where(F.pmod("h", F.lit(1 << 31)) < F.try_element_at(share, F.col("lang")) * (1 << 31))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = some.withColumn("place", place).where(F.col("place") <= rows).select("lang", "text", "h").toPandas().sort_values(["h", "lang", "text"])
    return train(sample["text"].tolist(), sample["lang"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, lang_pred, score, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = predict(model, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.35, label: str | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have a language with a mean probability of ``least`` or more; the column ``label``, if
    named, holds that language afterwards."""
    at, to = docs.columns.index("text"), None if label is None else docs.columns.index(label)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = predict(model, part.column(at).to_pylist())
                keep = pa.array([x != UNDETERMINED and s >= least for x, s in found], pa.bool_())
                names = pa.array([x for x, _ in found], pa.string())
                columns = [names if i == to else part.column(i) for i in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=batch.schema.names)

    return docs.mapInArrow(rows, docs.schema)


def fold(ids: str = "doc_id", n: int = 3):
    return F.crc32(F.col(ids).cast("string").cast("binary")) % n
