"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on
windows of a bounded sample of labelled documents. Applied, it reads every
byte of every text: texts are cut into stretches of ``SPAN`` bytes that run
side by side, each with ``WARM`` bytes before and after it to settle the
states; it labels every position that is part of a letter, and a document's
probabilities are the mean over its labelled positions.

Gates are the piecewise linear sigmoid clip(x / 4 + 1 / 2, 0, 1).

Defined cases: a null text or one without a letter is ``und`` with score 0;
labels that are null are not learned from; without any label all is ``und``;
repeated rows are judged each for itself; other columns are ignored; ties go
to the label that sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, tidy

HIDDEN, SPAN, WARM, LANES = 8, 192, 16, 2048
#: Documents per label and windows of each that training may see, the windows' length, and how long it goes on.
SAMPLE, WINDOWS, WINDOW_BYTES = 300, 4, 120
STEPS, BATCH, RATE, SEED = 260, 256, 0.02, 7


@dataclass
class Network:
    """Per direction: ``inputs`` (3H, 256) by byte, ``hidden`` (3H, H), ``bias`` (3H,); rows are update, reset, candidate.
    ``out`` (labels, 2H) and ``out_bias``."""

    labels: list[str]
    inputs: list[np.ndarray]
    hidden: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.hidden, *self.bias, self.out, self.out_bias]


def new_network(labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    r = np.random.RandomState(seed)
    make = lambda *shape, scale: (r.randn(*shape) * scale).astype(np.float32)
    return Network(labels, [make(3 * hidden, 256, scale=0.3) for _ in "fb"], [make(3 * hidden, hidden, scale=hidden**-0.5) for _ in "fb"], [np.zeros(3 * hidden, np.float32) for _ in "fb"], make(len(labels), 2 * hidden, scale=0.3), np.zeros(len(labels), np.float32))


def _states(inputs, hidden, bias, x, keep=None, alive=None):
    """Hidden states (T, H, lanes) over bytes x (T, lanes), in the order of x; ``keep`` gets what the way back needs.
    Where ``alive`` (T, lanes) is false the state is zero."""
    H = hidden.shape[1]
    h = np.zeros((H, x.shape[1]), np.float32)
    out = np.empty((len(x), *h.shape), np.float32)
    rows = inputs + bias[:, None]
    rec = np.empty((3 * H, x.shape[1]), np.float32)
    for t, b in enumerate(x):
        a = rows.take(b, axis=1)
        np.matmul(hidden, h, out=rec)
        g = a[: 2 * H]
        g += rec[: 2 * H]
        if keep is not None:
            raw = g.copy()
        g *= 0.25
        g += 0.5
        np.clip(g, 0, 1, out=g)
        z, r = g[:H], g[H:]
        n = a[2 * H :]
        n += r * rec[2 * H :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((raw, z.copy(), r.copy(), n.copy(), h, rec[2 * H :].copy()))
        h = n + z * (h - n)
        if alive is not None and not alive[t].all():
            h *= alive[t]
        out[t] = h
    return out


def _letters(x: np.ndarray) -> np.ndarray:
    """Bytes that are letters, or part of a character beyond ASCII."""
    low = x | 32
    return ((low >= 97) & (low <= 122)) | (x >= 128)


def train(texts: list[str], of: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """From windows of text and their labels. Adam on the mean cross-entropy over the letters' positions."""
    labels = sorted(set(of))
    net = new_network(labels, hidden, seed)
    raws = [t.encode("utf-8", "surrogatepass")[:WINDOW_BYTES].decode("utf-8", "ignore").encode() for t in texts]  # no part of a character
    data = np.full((len(raws), WINDOW_BYTES), 32, np.uint8)
    for i, raw in enumerate(raws):
        data[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    index = {y: k for k, y in enumerate(labels)}
    target = np.array([index[y] for y in of])
    by_label = [np.flatnonzero(target == k) for k in range(len(labels))]
    r = np.random.RandomState(seed)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(rows, -(-BATCH // len(labels))) for rows in by_label])
        grads = gradients(net, data[pick].T, target[pick])
        rate = RATE * min(1.0, 2.0 * (1 - (step - 1) / steps))
        norm = max(1.0, float(np.sqrt(sum(float((g * g).sum()) for g in grads))))
        for p, g, m, v in zip(params, grads, first, second):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def loss(net: Network, x: np.ndarray, y: np.ndarray) -> float:
    """Mean cross-entropy over the letters' positions of bytes x (T, lanes) with labels y."""
    both = np.concatenate([_states(net.inputs[0], net.hidden[0], net.bias[0], x), _states(net.inputs[1], net.hidden[1], net.bias[1], x[::-1])[::-1]], 1)
    s = np.einsum("lh,thb->tlb", net.out, both) + net.out_bias[:, None]
    s = s - s.max(1, keepdims=True)
    logp = s - np.log(np.exp(s).sum(1, keepdims=True))
    mask = _letters(x)
    return float(-(logp[:, y, np.arange(len(y))] * mask).sum() / max(1, mask.sum()))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of ``loss``, by backpropagation through time, in the order of ``parameters``."""
    H = net.hidden[0].shape[1]
    kept: list[list] = [[], []]
    xs = [x, x[::-1]]
    hs = [_states(net.inputs[d], net.hidden[d], net.bias[d], xs[d], kept[d]) for d in (0, 1)]
    both = np.concatenate([hs[0], hs[1][::-1]], 1)
    s = np.einsum("lh,thb->tlb", net.out, both) + net.out_bias[:, None]
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[:, y, np.arange(len(y))] -= 1
    mask = _letters(x)
    p *= (mask / max(1, mask.sum()))[:, None, :].astype(np.float32)
    d_out = np.einsum("tlb,thb->lh", p, both)
    d_bias = p.sum((0, 2))
    d_both = np.einsum("lh,tlb->thb", net.out, p)
    d_in, d_hid, d_b = [], [], []
    for d in (0, 1):
        dh_all = d_both[:, :H] if d == 0 else d_both[::-1, H:]
        U = net.hidden[d]
        gin, ghid = np.zeros((256, 3 * H), np.float32), np.zeros_like(U)
        gb = np.zeros(3 * H, np.float32)
        dh = np.zeros((H, x.shape[1]), np.float32)
        for t in range(len(x) - 1, -1, -1):
            raw, z, r, n, before, rec = kept[d][t]
            dh = dh + dh_all[t]
            dn = dh * (1 - z) * (1 - n * n)
            inside = (np.abs(raw) < 2) * np.float32(0.25)
            dz = dh * (before - n) * inside[:H]
            dr = dn * rec * inside[H:]
            pre = np.concatenate([dz, dr, dn])
            np.add.at(gin, xs[d][t], pre.T)
            gb += pre.sum(1)
            pre[2 * H :] *= r
            ghid += pre @ before.T
            dh = dh * z + U.T @ pre
        d_in.append(gin.T)
        d_hid.append(ghid)
        d_b.append(gb)
    return [*d_in, *d_hid, *d_b, d_out, d_bias]


def probabilities(net: Network, texts: list[str | None]) -> np.ndarray:
    """(texts, labels): means over the labelled positions of each whole text; zeros where there is none."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer((b" " * WARM).join([b"", *raws, b" " * (SPAN + WARM)]), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    begin = WARM + np.cumsum(sizes + WARM) - sizes - WARM
    spans = -(-sizes // SPAN)
    of = np.repeat(np.arange(len(raws)), spans)
    offset = (np.arange(len(of)) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN
    start, left = begin[of] + offset, np.minimum(SPAN, sizes[of] - offset)
    order = np.argsort(-left, kind="stable")
    total = np.zeros((len(raws), len(net.labels)))
    count = np.zeros(len(raws))
    H = net.hidden[0].shape[1]
    for lanes in (order[i : i + LANES] for i in range(0, len(order), LANES)):
        n = int(left[lanes].max())
        place = np.arange(-WARM, n + WARM)[:, None]
        x = flat[np.minimum(start[lanes] + place, len(flat) - 1)]
        # Only the lane's own stretch, with its warming ends in the same text, is read.
        alive = (place + offset[lanes] >= 0) & (place + offset[lanes] < sizes[of[lanes]]) & (place < left[lanes] + WARM)
        mask = _letters(x[WARM : WARM + n]) & (np.arange(n)[:, None] < left[lanes])
        ahead = _states(net.inputs[0], net.hidden[0], net.bias[0], x[: WARM + n], alive=alive[: WARM + n])[WARM:]
        back = _states(net.inputs[1], net.hidden[1], net.bias[1], x[WARM:][::-1], alive=alive[WARM:][::-1])[WARM:][::-1]
        pooled = np.zeros((len(net.labels), len(lanes)), np.float32)
        for t in range(n):
            s = net.out[:, :H] @ ahead[t]
            s += net.out[:, H:] @ back[t]
            s += net.out_bias[:, None]
            s -= s.max(0)
            np.exp(s, out=s)
            s *= mask[t] / s.sum(0)
            pooled += s
        np.add.at(total, of[lanes], pooled.T)
        np.add.at(count, of[lanes], mask.sum(0))
    return total / np.maximum(count, 1)[:, None]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learned(docs: DataFrame, per_label: int = SAMPLE, label: str = "lang") -> Network | None:
    """A network trained on about ``per_label`` documents of each label, chosen by a hash, and windows from all over each."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col(f"`{label}`").isNotNull() & has_letter(F.col("text"))).select(F.col(f"`{label}`").alias("y"), "doc_id", "text")
    counts = few(usable.groupBy("y").agg(F.count("*").alias("n")))
    n = F.length("text")
    windows = F.array(*(F.substring(F.col("text"), F.floor((n - WINDOW_BYTES) * (i / max(1, WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW_BYTES)) for i in range(WINDOWS)))
    windows = F.when(n <= WINDOW_BYTES, F.array("text")).otherwise(windows)
    chosen = usable.join(counts, "y").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.ceil(F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(per_label) / F.col("n"))))
    # A repeated row has one hash, so all its copies are chosen or none: once is enough.
    chosen = chosen.select("y", "doc_id", windows.alias("w")).dropDuplicates()
    rows = chosen.select("y", F.explode("w").alias("x")).orderBy("y", "x").toArrow()
    if not rows.num_rows:
        return None
    return train(rows.column("x").to_pylist(), rows.column("y").to_pylist())


def predicted(docs: DataFrame, net: Network | None, columns: list[str], named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of ``docs`` with the predicted label and its probability.

    Inside, columns go by their places, so that any name may stand beside others.
    """
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select(*kept, F.col("text").alias("t"), has_letter(F.col("text")).alias("l")) if "text" not in columns else docs.select(*kept, has_letter(F.col("text")).alias("l"))
    at_text = columns.index("text") if "text" in columns else len(columns)

    def run(batches):
        for b in batches:
            texts, letter = b.column(at_text), np.array(b.column(b.num_columns - 1).to_pylist(), bool)
            for at in range(0, len(texts), 512):
                k = min(512, len(texts) - at)
                said, score = np.full(k, "und", object), np.zeros(k)
                if net is not None:
                    p = probabilities(net, texts.slice(at, k).to_pylist())
                    best = p.argmax(1)
                    ok = letter[at : at + k]
                    said[ok] = np.array(net.labels, object)[best[ok]]
                    score[ok] = np.minimum(1.0, p[np.arange(k), best])[ok]
                out = [b.column(c).slice(at, k) for c in range(len(columns))]
                yield pa.RecordBatch.from_arrays([*out, pa.array(said, pa.string()), pa.array(score)], names=names)

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    names = [*(f"c{i}" for i in range(len(columns))), "said", "p"]
    schema = "".join(f"c{i} {types[c]}, " for i, c in enumerate(columns)) + "said string, p double"
    return rows.mapInArrow(tidy(run), schema).toDF(*columns, *named)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    net = learned(docs)
    return predicted(docs, net, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_sure(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known (not ``und``) and has a probability of ``least`` or more."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    net = learned(docs)
    found = predicted(docs.select("*"), net, docs.columns, ("said", "p")).toDF(*places, "said", "p")
    return found.filter((F.col("said") != "und") & (F.col("p") >= least)).select(*places).toDF(*docs.columns)
