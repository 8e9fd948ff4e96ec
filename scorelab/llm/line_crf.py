"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. A line's features describe its bytes and words, how much it
repeats within the text, and the lines before and after it. A document's score is the
mean over its lines, weighted by length, of the forward-backward probability of being
good. Labels of lines are latent: the fit sees documents' labels alone and makes them likely
under the scores, so a good document may hold bad lines, and the chain learns how
strongly neighbours agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelab.llm.arrow import map_slices
from scorelab.llm.samples import fold, labelled_sample
from scorelab.llm.shingles import _SPACE, mix, word_hashes
from scorelab.llm.store import written

SAMPLE = 4000        # most labelled documents that the model is fitted on
LINES = 300_000      # lines of those documents, about: in the order of a hash, whole documents until so many are reached
STEEP = 10.0         # log odds of a document's label for each unit of the good share of its length above a half
CELLS = 1 << 16      # lines that are padded to rows of one length at a time (one text may have more)
SLICE = 1 << 20

_CLASS = np.zeros((256, 8), np.float32)    # upper, lower, digit, symbol, other punctuation, space, not ASCII, continuation byte
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = [65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _c in "#*$%&|<>@^~=+_{}[]\\", _c in ".,;:!?'\"()-/`", _SPACE[_b], _b >= 192, 128 <= _b < 192]
N_OWN = 17


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with a word, its length in bytes, and the number of such lines of each text."""
    lines, doc = [], []
    for d, t in enumerate(texts):
        for x in t.split(b"\n"):
            if x.strip(b" \t\r\x0b\x0c"):
                lines.append(x)
                doc.append(d)
    counts = np.bincount(np.array(doc, np.int64), minlength=len(texts)) if doc else np.zeros(len(texts), np.int64)
    if not lines:
        return np.zeros((0, 3 * N_OWN + 3), np.float32), np.zeros(0), counts
    doc = np.array(doc)
    size = np.array([len(x) for x in lines])
    buf = np.frombuffer(b"".join(lines), np.uint8)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    shares = np.stack([np.add.reduceat(_CLASS[:, k][buf], first) for k in range(8)], 1)
    h, words = word_hashes(lines)
    line_of = np.repeat(np.arange(len(lines)), words)
    first_word = np.concatenate([[0], np.cumsum(words)])[:-1]
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    n = np.maximum(words, 1)
    # words that the line holds before; word triples that the text holds elsewhere
    key = mix(h + line_of.astype(np.uint64))
    fresh = np.zeros(len(h), np.float32)
    fresh[np.unique(key, return_index=True)[1]] = 1
    distinct = np.add.reduceat(fresh, first_word)
    triple = np.zeros(len(h), np.float32)
    if len(h) > 2:
        same = doc[line_of[:-2]] == doc[line_of[2:]]
        t = mix(h[:-2] + mix(h[1:-1] + mix(h[2:]))) ^ salt[line_of[:-2]]
        _, of, times = np.unique(t, return_inverse=True, return_counts=True)
        again = (times[of] > 1) & same
        for k in range(3):
            triple[k:len(h) - 2 + k][again] = 1
    repeated = np.add.reduceat(triple, first_word)
    text = mix(np.add.reduceat(h * (np.arange(len(h)) - first_word[line_of] + 1).astype(np.uint64), first_word)) ^ salt
    _, at, of = np.unique(text, return_index=True, return_inverse=True)
    earlier = at[of] != np.arange(len(lines))
    last = np.array([x.rstrip(b" \t\r\x0b\x0c")[-1] for x in lines])
    upper_words = np.zeros(len(lines), np.float32)
    letters = np.maximum(shares[:, 0] + shares[:, 1], 1)
    upper_words[:] = shares[:, 0] / letters
    shares /= size[:, None]
    own = np.column_stack([shares, np.log1p(size) / 5, np.log1p(words) / 4, size / n / 10, distinct / n, repeated / n, earlier,
                           np.isin(last, np.frombuffer(b".!?\"')", np.uint8)), upper_words, np.minimum(shares[:, 3] * size / n, 3)]).astype(np.float32)
    start = np.r_[True, doc[1:] != doc[:-1]]
    end = np.r_[doc[1:] != doc[:-1], True]
    before = np.where(start[:, None], 0, np.roll(own, 1, 0))
    after = np.where(end[:, None], 0, np.roll(own, -1, 0))
    return np.column_stack([own, before, after, start, end, np.ones(len(own))]).astype(np.float32), size, counts


def _padded(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), int(counts.max()), *values.shape[1:]), np.float64)
    row = np.repeat(np.arange(len(counts)), counts)
    col = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[row, col] = values
    return out


def forward_backward(score: np.ndarray, counts: np.ndarray, pair: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) of each line (padded rows) and expected transitions (2 x 2) of each row.

    ``score`` is the log odds for good from each line's features; rows are padded to the
    longest; ``pair`` and ``start`` are log weights of transitions and first states."""
    rows, steps = score.shape
    emit = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], 2)
    emit /= emit.sum(2, keepdims=True)
    move, begin = np.exp(pair), np.exp(start)
    alpha, beta = np.zeros((rows, steps, 2)), np.ones((rows, steps, 2))
    a = begin * emit[:, 0]
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        on = np.flatnonzero(counts > t)
        a = (alpha[on, t - 1] @ move) * emit[on, t]
        alpha[on, t] = a / a.sum(1, keepdims=True)
    expected = np.zeros((rows, 2, 2))
    for t in range(steps - 2, -1, -1):
        on = np.flatnonzero(counts > t + 1)
        b = emit[on, t + 1] * beta[on, t + 1]
        joint = alpha[on, t][:, :, None] * move * b[:, None, :]
        expected[on] += joint / joint.sum((1, 2), keepdims=True)
        b = b @ move.T
        beta[on, t] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    return both[:, :, 1] / np.maximum(both.sum(2), 1e-300), expected


def groups(counts: np.ndarray) -> list[np.ndarray]:
    """Rows in order of length, cut so that a group padded to its longest row has at most ``CELLS`` cells and 64 rows."""
    out, held = [], []
    for i in np.argsort(counts, kind="stable").tolist():
        if held and (len(held) >= 64 or (len(held) + 1) * counts[i] > CELLS):
            out.append(np.array(held))
            held = []
        held.append(i)
    return [*out, np.array(held)] if held else out


def slopes(score: np.ndarray, counts: np.ndarray, weight: np.ndarray, pair: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's score q (mean of the marginals by ``weight``, which sums to 1), and its slopes in the lines' scores and in
    the transitions. A slope is a covariance with the weighted number of good lines, which is how marginals and expected
    transitions change as the scores move along the weights."""
    step = 1e-3 / weight.max(1, keepdims=True)
    p, _ = forward_backward(score, counts, pair, start)
    up, moves_up = forward_backward(score + step * weight, counts, pair, start)
    down, moves_down = forward_backward(score - step * weight, counts, pair, start)
    return (p * weight).sum(1), (up - down) / (2 * step), (moves_up - moves_down) / (2 * step[:, :, None])


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 40, l2: float = 1e-4, near: float = 0.1, seed: int = 1) -> dict:
    """Fit by Adam over groups of documents: (features of the lines, their lengths, label). Documents count alike, whatever their length.

    ``near`` is the penalty on the weights of neighbouring lines' features (a fifth of it on transitions): documents'
    labels alone could be told from either, and a line is to be judged by itself first."""
    docs = [d for d in docs if len(d[0])]
    good = sum(d[2] for d in docs)
    width = docs[0][0].shape[1] if docs else 3 * N_OWN + 3
    model = {"w": np.zeros(width), "pair": np.zeros((2, 2)), "start": np.zeros(2), "mean": np.zeros(width), "scale": np.ones(width),
             "prior": (good + 1) / (len(docs) + 2)}
    if not docs or good in (0, len(docs)):
        return model
    every = np.concatenate([d[0] for d in docs])
    model["mean"], model["scale"] = every.mean(0), every.std(0) + 1e-3
    model["mean"][-1], model["scale"][-1] = 0, 1
    batches = [[docs[i] for i in g] for g in groups(np.array([len(d[0]) for d in docs]))]
    rng = np.random.Generator(np.random.PCG64(seed))
    params = [model["w"], model["pair"], model["start"]]
    decay = np.full(width, l2)
    decay[N_OWN:3 * N_OWN] = near
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            part = batches[b]
            counts = np.array([len(d[0]) for d in part])
            y = np.array([d[2] for d in part])
            x = (np.concatenate([d[0] for d in part]) - model["mean"]) / model["scale"]
            weight = _padded(np.concatenate([d[1] for d in part]).astype(float), counts)
            weight /= weight.sum(1, keepdims=True)
            q, by_line, by_move = slopes(_padded(x @ params[0], counts), counts, weight, params[1], params[2])
            # most of a document's length decides its label: beyond that, nothing is asked of its lines
            off = STEEP * (y - 1 / (1 + np.exp(-STEEP * (q - 0.5))))
            inside = np.arange(weight.shape[1])[None, :] < counts[:, None]
            first = np.array([-(off * by_line[:, 0]).sum(), (off * by_line[:, 0]).sum()])
            grads = [(off[:, None] * by_line)[inside] @ x / len(part) - decay * params[0],
                     (off[:, None, None] * by_move).sum(0) / len(part) - near / 5 * params[1], first / len(part) - l2 * params[2]]
            step += 1
            rate = 0.05 * (1 - epoch / epochs) + 0.002
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                if k:
                    np.clip(params[k], -4, 4, out=params[k])
    return model


def marginals(model: dict, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """P(good) and length of each line with a word, for each text."""
    x, size, counts = line_features(texts)
    out = [np.zeros(0)] * len(texts)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    if len(some):
        score = np.concatenate([((x[i:i + CELLS] - model["mean"]) / model["scale"]) @ model["w"] for i in range(0, len(x), CELLS)])
        for group in groups(counts[some]):
            rows = some[group]
            at = np.concatenate([np.arange(ends[d] - counts[d], ends[d]) for d in rows])
            p, _ = forward_backward(_padded(score[at], counts[rows]), counts[rows], model["pair"], model["start"])
            for d, line in zip(rows, p):
                out[d] = line[:counts[d]].copy()
    return out, np.split(size, ends[:-1])


def predict(model: dict, texts: list[bytes]) -> list[float]:
    """Quality of each text; a text without lines has the share of good documents in the fit."""
    p, size = marginals(model, texts)
    out = [float((a * b).sum() / b.sum()) if len(a) else model["prior"] for a, b in zip(p, size)]
    return np.clip(out, 0, 1).tolist()


def _texts(column) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held_out: int = 2, sample: int = SAMPLE, lines: int = LINES, **cols) -> dict:
    """Fit the model on at most ``sample`` labelled documents outside the held-out fold, and of those, in the order of a hash
    of the text, as many as have about ``lines`` lines together: whole documents of any length. Their line features
    are made by Spark; what reaches the driver is bounded by ``lines`` and one document."""
    some = labelled_sample(docs, labels, label, folds, held_out, sample, **cols).withColumn("h", F.xxhash64("text"))
    rows = written(some.withColumn("m", F.monotonically_increasing_id()), "quality-sample")
    before = F.coalesce(F.sum("n").over(W.orderBy("h", "m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.select("h", "m", F.regexp_count("text", F.lit("[^\n]+")).alias("n"))     # of at most ``sample`` rows
    chosen = sizes.withColumn("before", before).where(F.col("before") < lines).select("m")

    def features(part: pa.RecordBatch) -> dict:
        x, size, counts = line_features(_texts(part.column("text")))
        ends = np.cumsum(counts)[:-1]
        return {"x": [p.tobytes() for p in np.split(x, ends)], "size": [p.astype("<i4").tobytes() for p in np.split(size, ends)], "y": part.column("y").to_pylist()}

    found = map_slices(rows.join(F.broadcast(chosen), "m").select("text", "y"), features, "x binary, size binary, y int", "text", limit=SLICE).collect()
    found = sorted((r for r in found if r["x"]), key=lambda r: (len(r["x"]), r["x"], r["y"]))
    return fit([(np.frombuffer(r["x"], np.float32).reshape(-1, 3 * N_OWN + 3), np.frombuffer(r["size"], "<i4"), int(r["y"] == 1)) for r in found])


def score(docs: DataFrame, model: dict, folds: int = 4, held_out: int = 2, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1, higher: better) and ``predicted`` of every row.

    Only the text is an input of the score. Null and empty texts score the share of good
    documents in the fit. Rows are scored one by one, so ties and repeated rows need
    nothing; an empty table gives an empty result; extra columns are ignored."""
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), (fold(id_col, folds) == held_out).alias("held_out"), F.col(f"`{text_col}`").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> dict:
        s = predict(model, _texts(part.column("_text")))
        return {"_id": part.column("_id"), "held_out": part.column("held_out"), "score": s, "predicted": [int(x >= cut) for x in s]}

    return map_slices(src, run, f"`_id` {kind}, held_out boolean, score double, predicted int", "_text", limit=SLICE).withColumnRenamed("_id", id_col)
