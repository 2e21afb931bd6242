"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is a step. Its input is a word vector (hashed), the mean of the vectors of its character runs and the
vector of its beginning. A text is cut into overlapping windows of ``STEPS`` words, all of which are scored; the
text's score comes from its strongest windows by a logistic regression.

Training uses a bounded sample: the first ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` other labelled rows in the order
of a hash of doc_id, up to ``MOST_CHARS`` characters, of the rows that the caller allows. Texts only have one label, so the windows to learn from
are chosen by the model of the round before (at first by word statistics of the sample): the strongest windows of
toxic texts, the strongest and some random ones of the others. Scoring covers all windows of all texts.

Defined cases: a null or wordless text is one empty window and gets a score; repeated rows are scored one by one;
an empty table gives no rows; extra columns are ignored; labels that are null, or a sample with one class only,
leave the model at the share of toxic labels (0.5 without any). Rows of labels without a document and documents
without a label take no part in training; a document labelled twice counts with each label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm import common

STEPS, STRIDE = 32, 24
HIDDEN = 8
WORD_ROWS, WORD_DIM = 1 << 15, 8
RUN_ROWS, RUN_DIM = 1 << 13, 6
START_ROWS, START_DIM = 1 << 13, 4
RUN, START = 4, 7
#: The sample's bound: labelled rows of either class that training sees.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: The sample's bound in characters: rows in the same order beyond it are not trained on.
MOST_CHARS = 24_000_000
EPOCHS, ROUNDS, BATCH, RATE = 5, 3, 192, 0.02
TOP = 6
#: Words a worker keeps inputs for.
CACHED = 150_000
BATCH_WINDOWS = 4096
THRESHOLD = 0.7
HIDE = 0.5
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """All words in lower case."""
    return _WORD.findall((text or "").lower())


def hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the word and beginning tables for each word; rows of its character runs and where each word's runs begin.

    A run lies in its word and the zero bytes behind it: what a word is given must not depend on the next one in the list.
    """
    marked = [b"^" + w.encode() + b"$" for w in words]
    crc = zlib.crc32
    word = np.fromiter(map(crc, marked), np.int64, len(words)) % WORD_ROWS
    start = np.fromiter((crc(m[:START]) for m in marked), np.int64, len(words)) % START_ROWS
    pad = b"\0" * (RUN - 3)
    wide = np.fromiter(map(len, marked), np.int64, len(words)) + len(pad)
    sizes = wide - RUN + 1
    begin = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(np.cumsum(wide) - wide - begin, sizes)
    b = np.frombuffer(pad.join([*marked, b""]), np.uint8).astype(np.int64)
    h = np.zeros(len(at), np.int64)
    for k in range(RUN):
        h = h * 257 + b[at + k]
    return word, start, h % RUN_ROWS, begin


@dataclass
class Model:
    """Weights. Gate columns are reset, update, new; the first axis of ``wx``, ``wh``, ``bx`` is the direction."""

    word: np.ndarray
    run: np.ndarray
    start: np.ndarray
    wx: np.ndarray
    bx: np.ndarray
    wh: np.ndarray
    wa: np.ndarray
    va: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    top: np.ndarray = field(default_factory=lambda: np.zeros(TOP + 1))
    share: float = 0.5
    trained: bool = False

    @staticmethod
    def new(seed: int = 7) -> Model:
        r = np.random.default_rng(seed)
        d = WORD_DIM + RUN_DIM + START_DIM
        g = lambda *s, by=1.0: (r.standard_normal(s) * by).astype(np.float32)
        return Model(
            g(WORD_ROWS, WORD_DIM, by=0.02), g(RUN_ROWS, RUN_DIM, by=0.02), g(START_ROWS, START_DIM, by=0.02), g(2, d, 3 * HIDDEN, by=0.4),
            np.zeros((2, 3 * HIDDEN), np.float32), g(2, HIDDEN, 3 * HIDDEN, by=0.3), g(2 * HIDDEN, HIDDEN, by=0.3), g(HIDDEN, by=0.3), g(2 * HIDDEN, by=0.3), np.zeros(1, np.float32),
        )


WEIGHTS = ("word", "run", "start", "wx", "bx", "wh", "wa", "va", "wo", "bo")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(m: Model, words: list[str], rows=None) -> np.ndarray:
    """Input vectors of distinct words."""
    word, start, runs, begin = rows or hashed(words)
    if not len(word):
        return np.zeros((0, WORD_DIM + RUN_DIM + START_DIM), np.float32)
    ends = np.append(begin[1:], len(runs))
    mean = np.add.reduceat(m.run[runs], begin, axis=0) / (ends - begin)[:, None]
    return np.hstack([m.word[word], mean, m.start[start]]).astype(np.float32)


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text's word numbers; -1 pads. A text without words is one empty window."""
    n = max(1, -(-(len(ids) - STEPS + STRIDE) // STRIDE)) if len(ids) > STEPS else 1
    padded = np.full((n - 1) * STRIDE + STEPS, -1, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, STEPS)[::STRIDE]


def logits(m: Model, projected: np.ndarray, win: np.ndarray) -> np.ndarray:
    """A logit per window; ``projected``: (2, words + 1, 3 * HIDDEN), the last row stands for padding."""
    n, out = len(win), []
    mask = win >= 0
    for lo in range(0, n, BATCH_WINDOWS):
        w, k = win[lo : lo + BATCH_WINDOWS].T, mask[lo : lo + BATCH_WINDOWS].T
        states = np.empty((STEPS, w.shape[1], 2 * HIDDEN), np.float32)
        for d in (0, 1):
            h = np.zeros((w.shape[1], HIDDEN), np.float32)
            for t in range(STEPS) if d == 0 else range(STEPS - 1, -1, -1):
                x, u = projected[d][w[t]], h @ m.wh[d]
                rz = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
                c = np.tanh(x[:, 2 * HIDDEN :] + rz[:, :HIDDEN] * u[:, 2 * HIDDEN :])
                z = rz[:, HIDDEN:] * k[t][:, None]
                h = h + z * (c - h)
                states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = h
        e = np.tanh(states @ m.wa) @ m.va
        e = np.exp(np.where(k, e, -30.0))
        pooled = np.einsum("tn,tnh->nh", e / e.sum(0), states)
        out.append(pooled @ m.wo + m.bo[0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def project(m: Model, x: np.ndarray) -> np.ndarray:
    p = np.stack([x @ m.wx[d] + m.bx[d] for d in (0, 1)])
    return np.concatenate([p, np.zeros((2, 1, 3 * HIDDEN), np.float32)], 1)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that have the same number in ``at``, as ``n`` rows."""
    k = values.shape[1]
    cells = (at[:, None] * k + np.arange(k)).ravel()
    return np.bincount(cells, values.ravel(), n * k).reshape(n, k).astype(np.float32)


def _gradients(m: Model, x: np.ndarray, win: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the mean log loss of the windows for the dense weights and for the input vectors ``x``.

    Both directions take a step together: the first axis is the direction, and the second one reads backwards.
    """
    n, hd = len(win), HIDDEN
    w, k = win.T, (win >= 0).T
    xs = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    way = np.stack([w, w[::-1]], 1)  # (step, direction, window)
    live = np.stack([k, k[::-1]], 1)[..., None].astype(np.float32)
    projected = xs @ m.wx + m.bx[:, None]
    sides = np.arange(2)[:, None]
    h, kept = np.zeros((2, n, hd), np.float32), []
    after = np.empty((STEPS, 2, n, hd), np.float32)
    for t in range(STEPS):
        a, u = projected[sides, way[t]], h @ m.wh
        rz = 1 / (1 + np.exp(-(a[..., : 2 * hd] + u[..., : 2 * hd])))
        r, z = rz[..., :hd], rz[..., hd:]
        c = np.tanh(a[..., 2 * hd :] + r * u[..., 2 * hd :])
        kept.append((h, r, z, c, u[..., 2 * hd :]))
        h = h + z * live[t] * (c - h)
        after[t] = h
    states = np.concatenate([after[:, 0], after[::-1, 1]], 2)
    q = np.tanh(states @ m.wa)
    e = np.exp(np.where(k, q @ m.va, -30.0))
    att = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", att, states)
    err = (_sigmoid(pooled @ m.wo + m.bo[0]) - y) / n
    g = {"wo": pooled.T @ err, "bo": np.array([err.sum()])}
    dp = err[:, None] * m.wo
    ds = att[:, :, None] * dp
    datt = np.einsum("tnh,nh->tn", states, dp)
    de = att * (datt - (att * datt).sum(0)) * k
    g["va"] = np.einsum("tn,tnh->h", de, q)
    dq = de[:, :, None] * m.va * (1 - q * q)
    g["wa"] = states.reshape(-1, 2 * hd).T @ dq.reshape(-1, dq.shape[2])
    ds = ds + dq @ m.wa.T
    ds = np.stack([ds[..., :hd], ds[::-1, :, hd:]], 1).astype(np.float32)
    back = m.wh.transpose(0, 2, 1)
    da, du = (np.empty((STEPS, 2, n, 3 * hd), np.float32) for _ in range(2))
    dh = np.zeros((2, n, hd), np.float32)
    for t in range(STEPS - 1, -1, -1):
        h, r, z, c, un = kept[t]
        dh = dh + ds[t]
        dc = dh * z * live[t] * (1 - c * c)
        dz = dh * (c - h) * live[t] * z * (1 - z)
        da[t, ..., :hd] = dc * un * r * (1 - r)
        da[t, ..., hd : 2 * hd] = dz
        da[t, ..., 2 * hd :] = dc
        du[t] = da[t]
        du[t, ..., 2 * hd :] *= r
        dh = dh * (1 - z * live[t]) + du[t] @ back
    before = np.stack([s[0] for s in kept])
    g["wh"] = np.stack([before[:, d].reshape(-1, hd).T @ du[:, d].reshape(-1, 3 * hd) for d in (0, 1)])
    g["bx"] = da.sum((0, 2))
    by_word = [_summed(way[:, d].ravel() % len(xs), da[:, d].reshape(-1, 3 * hd), len(xs)) for d in (0, 1)]  # -1 is the last row
    g["wx"] = np.stack([xs.T @ s for s in by_word])
    return g, sum(s @ m.wx[d].T for d, s in enumerate(by_word))[:-1]


def _log_odds(count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of being in a toxic text by their error, for columns of (clean, toxic) counts of texts."""
    c, t = count
    z = np.log((t + 0.3) / (n[1] + 1) * (n[0] + 1) / (c + 0.3)) / np.sqrt(1 / (t + 0.3) + 1 / (c + 0.3))
    return np.where(c + t > 2, np.clip(z, -3, 6) / 3, 0.0)


def _start_vectors(m: Model, names: list[str], texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of words and of beginnings in the sample's toxic texts fill one column of each table; their sums."""
    starts: dict[bytes, int] = {}
    start_of = np.array([starts.setdefault(("^" + w + "$").encode()[:START], len(starts)) if len(w) > 4 else -1 for w in names], np.int64)
    words, heads = np.zeros((2, len(names))), np.zeros((2, len(starts) + 1))
    for ids, label in zip(texts, y.astype(int).tolist(), strict=True):
        seen = np.unique(ids)
        words[label, seen] += 1
        heads[label, np.unique(start_of[seen])] += 1
    n = np.array([max(1.0, len(y) - y.sum()), max(1.0, y.sum())])
    zw, zs = _log_odds(words, n), _log_odds(heads, n)
    zs[-1] = 0.0
    for w, z in zip(names, zw.tolist(), strict=True):
        if z:
            m.word[zlib.crc32(b"^" + w.encode() + b"$") % WORD_ROWS, 0] = z
    for s, k in starts.items():
        if zs[k]:
            m.start[zlib.crc32(s) % START_ROWS, 0] = zs[k]
    return (zw + zs[start_of]).astype(np.float32)


def train(rows: list[tuple[str | None, int]], seed: int = 7) -> Model:
    """A model from (text, label) rows."""
    m, r = Model.new(seed), np.random.default_rng(seed)
    y = np.array([t for _, t in rows], np.float32)
    m.share = float(y.mean()) if len(y) else 0.5
    if len(y) < 8 or y.min() == y.max():
        return m
    number: dict[str, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t, _ in rows]
    names = list(number)
    weight = _start_vectors(m, names, texts, y)
    hashes = hashed(names)
    ends = np.append(hashes[3][1:], len(hashes[2]))
    wins = [windows_of(t) for t in texts]
    owner = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    wins = np.concatenate(wins)
    prior = np.append(np.maximum(weight, 0), np.float32(0))
    strength = prior[wins].sum(1)
    moments = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in WEIGHTS}
    steps, least = 0, np.inf
    for _ in range(ROUNDS):
        order = np.lexsort((-strength, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        toxic = y[owner[order]] > 0
        best = strength[order[rank == 0]]
        good = strength[order] >= np.minimum(best[owner[order]] - 2, 0.5 * best[owner[order]])
        chosen = order[np.where(toxic, (rank == 0) | (rank < 4) & good, (rank < 2) | (r.random(len(order)) < 0.03))]
        per_epoch = -(-len(chosen) // BATCH)
        for epoch in range(EPOCHS):
            mixed = r.permutation(chosen)
            for step in range(per_epoch):
                # steps get shorter to the end of a round, so that no single batch decides where it ends
                rate = RATE * (1 - (epoch * per_epoch + step) / (EPOCHS * per_epoch))
                pick = mixed[step * BATCH : (step + 1) * BATCH]
                used, inv = np.unique(wins[pick], return_inverse=True)
                shift = int(used[0] < 0)
                used, local = used[shift:], inv.reshape(wins[pick].shape) - shift
                sizes = ends[used] - hashes[3][used]
                begin = np.cumsum(sizes) - sizes
                runs = hashes[2][np.arange(sizes.sum()) + np.repeat(hashes[3][used] - begin, sizes)]
                rows_of = (hashes[0][used], hashes[1][used], runs, begin)
                x = inputs(m, [], rows_of)
                seen = np.ones_like(x)  # words are hidden at times, so that characters must do
                seen[r.random(len(x)) < HIDE, :WORD_DIM] = 0
                g, dx = _gradients(m, x * seen, local, y[owner[pick]])
                dx = dx * seen
                steps += 1
                sparse = {"word": (rows_of[0], dx[:, :WORD_DIM]), "run": (runs, np.repeat(dx[:, WORD_DIM : WORD_DIM + RUN_DIM] / sizes[:, None], sizes, 0)), "start": (rows_of[1], dx[:, WORD_DIM + RUN_DIM :])}
                for k in WEIGHTS:
                    value, (m1, m2) = getattr(m, k), moments[k]
                    if k in sparse:
                        at, inv = np.unique(sparse[k][0], return_inverse=True)
                        grad = _summed(inv, sparse[k][1], len(at))
                    else:
                        at, grad = ..., g[k]
                    m1[at] = 0.9 * m1[at] + 0.1 * grad
                    m2[at] = 0.99 * m2[at] + 0.01 * grad * grad
                    value[at] -= rate * (m1[at] / (1 - 0.9**steps)) / (np.sqrt(m2[at] / (1 - 0.99**steps)) + 1e-6) + (2e-4 * value[at])
        strength = logits(m, project(m, inputs(m, names, hashes)), wins)
        f = _features(strength, owner, len(y))
        top, loss = _fit_top(f, y), _top_loss(f, y)
        if loss <= least:  # a round that went astray is not what stays
            least, best_round = loss, ({k: getattr(m, k).copy() for k in WEIGHTS}, top)
    if least < np.inf:
        for k, v in best_round[0].items():
            setattr(m, k, v)
        m.top, m.trained = best_round[1], True
    return m


def _features(strength: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The strongest logits of each text, clipped; the last one repeated where a text has fewer windows."""
    order = np.lexsort((-strength, owner))
    first = np.searchsorted(owner[order], np.arange(n))
    count = np.bincount(owner, minlength=n)
    at = first[:, None] + np.minimum(np.arange(TOP), count[:, None] - 1)
    return np.clip(strength[order][at], -8, 8).astype(np.float64)


def _penalised_loss(a: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = a @ w
    return float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + 0.05 * (w @ w))


def _regression(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns with an offset, and their logistic regression with a penalty: Newton's method, a step that makes it
    worse is halved."""
    a, w = np.hstack([f, np.ones((len(f), 1))]), np.zeros(f.shape[1] + 1)
    w[0] = 0.5
    now = _penalised_loss(a, y, w)
    for _ in range(30):
        p = _sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w)), a.T @ (p - y) + 0.1 * w)
        for _ in range(40):
            if (then := _penalised_loss(a, y, w - step)) <= now:
                w, now = w - step, then
                break
            step = step / 2
    return a, w


def _top_loss(f: np.ndarray, y: np.ndarray) -> float:
    """Mean log loss of the regression; infinite if there is a feature that is no number."""
    if not np.isfinite(f).all():
        return np.inf
    a, w = _regression(f, y)
    return _penalised_loss(a, y, w) / len(y)


def _fit_top(f: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression; its offset is then moved so that the predicted label (score >= THRESHOLD) has the best F1 on
    the sample. Texts that are equally strong are all predicted alike, and never is every text predicted as toxic: where
    nothing tells the texts apart the offset stays."""
    a, w = _regression(f, y)
    z = np.round(a @ w, 9)
    order = np.argsort(-z, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(z[order][:-1] > z[order][1:])
    if not len(ends):
        return w
    best = int(ends[np.argmax(f1[ends])])
    cut = (z[order[best]] + z[order[best + 1]]) / 2
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the driver on the bounded sample of documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    order = F.xxhash64("doc_id")
    ids = [r for t, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)) for r in known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(most).collect()]
    if not ids:
        return train([])
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")  # MOST_TOXIC + MOST_CLEAN rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.orderBy(order, "doc_id", "text", "toxic")
    sizes = [r["n"] for r in rows.limit(2 * (MOST_TOXIC + MOST_CLEAN)).select(F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()]
    some = int(np.searchsorted(np.cumsum(sizes), MOST_CHARS, "right"))
    return train([(r["text"], r["toxic"]) for r in rows.limit(some).collect()] if some else [])


def _score_texts(m: Model, texts: list[str | None], key: str) -> np.ndarray:
    """Scores of texts; input vectors of words are kept by the worker."""
    if not m.trained:
        return np.full(len(texts), m.share)
    kept = common.worker_cache("toxicity")
    if kept.get("key") != key or len(kept["number"]) > CACHED:
        kept.clear()
        kept.update(key=key, number={}, table=np.zeros((2, 1, 3 * HIDDEN), np.float32))
    number = kept["number"]
    split = [words_of(t) for t in texts]
    new = list({w for t in split for w in t if w not in number})
    if new:
        base = len(number)
        number.update(zip(new, range(base, base + len(new)), strict=True))
        table = kept["table"]
        if table.shape[1] < len(number) + 1:  # grown by halves
            bigger = np.zeros((2, int(1.5 * len(number)) + 1000, 3 * HIDDEN), np.float32)
            bigger[:, : table.shape[1] - 1] = table[:, :-1]
            table = kept["table"] = bigger
        table[:, base : len(number)] = project(m, inputs(m, new))[:, :-1]
    wins = [windows_of(np.fromiter(map(number.__getitem__, t), np.int32, len(t))) for t in split]
    owner = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
    f = _features(logits(m, kept["table"], np.concatenate(wins)), owner, len(texts))
    return _sigmoid(f @ m.top[:-1] + m.top[-1])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a double column of scores; the model (a few MB, whatever the input) is a broadcast variable."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), f"{id(model)}-{spark.sparkContext.applicationId}-{model.top.tolist()}"
    docs = docs.drop(name)
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                values = _score_texts(shared.value, part.column(at).to_pylist(), key)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
