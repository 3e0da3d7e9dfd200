"""Quality classifier: a linear-chain conditional random field over lines.

Every non-blank line is labelled good or bad.  The features of a line are
ratios of its own characters and words and those of the lines before and
after it; transitions tie neighbouring labels together.  The probability that
a document is good is the mean of its lines' forward-backward marginals,
weighted by length, and put on the scale of the labels by a logistic curve.

It is trained from document labels, which all lines of a document inherit,
on at most `sample` labelled documents, about half of each label, chosen by a
hash of their ids; of those, ones with over `most_lines` lines stay out, and
so do the ones behind the first `sample_lines` lines.  The lines' ratios of
the sample go to the driver: that is its bound, some 50 bytes a line.

Defined cases: a text without a word has no lines and gets the share of
good documents in training as its score; without labels of both kinds that
share is everyone's score (0.5 without any); repeated rows score alike; a
document labelled twice counts with each label; whole texts count.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MARKS = "#*$%&|<>@^~=_{}\\+"
ENDS = ".!?:;\"'”»)"
#: Own ratios of a line; each is also cut at two limits.
LIMITS = ((0.01, 0.05), (0.2, 0.5), (0.02, 0.2), (0.05, 0.3), (0.3, 0.6), (0.05, 0.3), (0.05, 0.2), (0.5, 0.5), (0.5, 0.5), (0.2, 0.5), (0.5, 0.5), (0.3, 0.6))
OWN = 3 * len(LIMITS) + 1
#: A line's features: a constant, its own, those of the line before and of the line after.
SIZE = 3 * OWN


class Model(NamedTuple):
    weights: np.ndarray  # of the features, for the label good
    moves: np.ndarray  # moves[a, b]: from label a to label b
    scale: tuple[float, float]  # slope and shift of the logistic curve
    share: float  # of good documents in training


def ratios(line: str, words: list[str], seen: set[str], before: str) -> tuple[float, ...]:
    n, chars = len(words), len(line)
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    distinct = len(set(words))
    pairs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = sum(map(line.count, MARKS))
    length = chars / n
    return (
        marks / chars,
        upper / n,
        line.count("!") / n,
        sum(map(line.count, "0123456789")) / chars,
        1 - distinct / n if n > 5 else 0.0,
        pairs / n,
        line.count("|") / n,
        float(line in seen),
        float(line == before),
        min(1.0, abs(length - 6) / 10),
        float(line[-1] not in ENDS),
        1 - letters / n,
    )


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Own features and lengths of a text's non-blank lines."""
    rows, lengths, seen, before = [], [], set(), ""
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        words = line.split()
        rows.append(ratios(line, words, seen, before))
        lengths.append(len(line))
        seen.add(line)
        before = line
    return cut_at_limits(np.array(rows, np.float32).reshape(len(rows), len(LIMITS))), np.array(lengths, np.float64)


def cut_at_limits(r: np.ndarray) -> np.ndarray:
    """Lines' own features, given their ratios."""
    low, high = np.array(LIMITS, np.float32).T
    return np.hstack([r, r > low, r > high, np.ones((len(r), 1), np.float32)]).astype(np.float32)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of all lines, given where each document starts."""
    n = len(own)
    out = np.zeros((n, SIZE), np.float32)
    out[:, :OWN] = own
    if n:
        out[1:, OWN : 2 * OWN] = own[:-1]
        out[:-1, 2 * OWN :] = own[1:]
        first = starts[starts < n]
        out[first, OWN : 2 * OWN] = 0
        last = np.append(first[1:], n) - 1
        out[last, 2 * OWN :] = 0
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of sequences laid end to end: P(good) of each line, expected moves, sum of log Z.

    All sequences go forward together, the longest first, so that those
    still running at a step are a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    n_steps = int(length[0]) if len(length) else 0
    top = np.maximum(scores, 0)
    e = np.stack([np.exp(-top), np.exp(scores - top)], 1)  # labels bad, good
    m = np.exp(moves - moves.max())
    forward, backward, norm = np.empty_like(e), np.empty_like(e), np.empty(len(e))
    running = np.searchsorted(-length, -np.arange(n_steps), side="left")
    for t in range(n_steps):
        k = running[t]
        at = starts[:k] + t
        a = e[at] if t == 0 else (forward[at - 1] @ m) * e[at]
        norm[at] = a.sum(1)
        forward[at] = a / norm[at, None]
    for t in range(n_steps - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        backward[at] = 1.0
        if t + 1 < n_steps:
            on = starts[: running[t + 1]] + t
            nxt = on + 1
            backward[on] = ((backward[nxt] * e[nxt]) @ m.T) / norm[nxt, None]
    both = forward * backward
    both /= both.sum(1, keepdims=True)
    inner = np.ones(len(e), bool)
    inner[starts[length > 0]] = False
    at = np.flatnonzero(inner)
    pair = forward[at - 1][:, :, None] * m[None] * (e[at] * backward[at])[:, None, :] / norm[at, None, None]
    log_z = float(np.log(norm).sum() + top.sum() + len(at) * moves.max())
    return both[:, 1], pair.sum(0), log_z


def by_document(values: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weighted means of runs of values; nan for empty runs."""
    ends = np.cumsum(sizes)
    total, mass = np.append(0.0, np.cumsum(values * weights)), np.append(0.0, np.cumsum(weights))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[ends] - total[ends - sizes]) / (mass[ends] - mass[ends - sizes])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(own: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the likelihood of the lines' inherited labels."""
    share = float(labels.mean()) if len(labels) else 0.5
    sizes = np.array([len(x) for x in own], np.int64)
    if not len(labels) or labels.min() == labels.max() or not sizes.sum():
        return Model(np.zeros(SIZE), np.zeros((2, 2)), (0.0, float(logit(np.array(share)))), share)
    x = with_neighbours(np.concatenate(own), np.cumsum(sizes) - sizes)
    y = np.repeat(labels, sizes).astype(float)
    inner = np.ones(len(y), bool)
    inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    w, moves = np.zeros(SIZE), np.zeros((2, 2))
    state = [np.zeros(SIZE + 4), np.zeros(SIZE + 4)]
    for k in range(1, rounds + 1):
        p, pairs, _ = marginals((x @ w.astype(np.float32)).astype(float), moves, sizes)
        slope = np.concatenate([((y - p).astype(np.float32) @ x) / len(y) - penalty * w, ((seen - pairs) / len(y) - penalty * moves).ravel()])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        step = 0.08 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        w, moves = w + step[:SIZE], moves + step[SIZE:].reshape(2, 2)
    p, _, _ = marginals((x @ w.astype(np.float32)).astype(float), moves, sizes)
    z, ok = logit(by_document(p, np.concatenate(lengths), sizes)), sizes > 0
    z, t = z[ok], labels[ok].astype(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method, lightly held at slope 1
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((t - q) * z).sum() - (a - 1), (t - q).sum() - 0.01 * b])
        v = q * (1 - q)
        h = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = max(0.05, a + da), b + db
    return Model(w, moves, (float(a), float(b)), share)


def scores_of(texts: list[str], model: Model) -> np.ndarray:
    got = [lines_of(t) for t in texts]
    sizes = np.array([len(x) for x, _ in got], np.int64)
    if not sizes.sum():
        return np.full(len(texts), model.share)
    x = with_neighbours(np.concatenate([x for x, _ in got]), np.cumsum(sizes) - sizes)
    p, _, _ = marginals((x @ model.weights.astype(np.float32)).astype(float), model.moves, sizes)
    z = logit(by_document(p, np.concatenate([n for _, n in got]), sizes))
    a, b = model.scale
    return np.where(sizes > 0, 1 / (1 + np.exp(-(a * z + b))), model.share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, most_lines: int = 1000, sample_lines: int = 200_000, **options) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality); the sample is drawn before the join, so that only its texts are moved."""
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return train([], [], np.empty(0))
    # each label gives half of the sample, or all that it has; a fifth more is drawn, for shares by hash are not exact
    shares = {q: min(1.0, 0.6 * sample / n) for q, n in counts.items()}
    hashed = F.xxhash64(F.lit(5), "doc_id")
    limit = F.when(F.col("quality") == 0, common.threshold(shares.get(0, 0.0))).otherwise(common.threshold(shares.get(1, 0.0)))
    share = F.when(F.col("quality") == 0, shares.get(0, 1.0)).otherwise(shares.get(1, 1.0))
    # some 1.2 * sample rows of three numbers
    some = known.filter(hashed <= limit).withColumn("u", (hashed / 2.0**64 + 0.5) / share)
    chosen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")

    def features(texts):
        own, lengths, many = [], [], []
        for t in texts:
            x, n = lines_of(t)
            own.append(np.ascontiguousarray(x[:, : len(LIMITS)]).tobytes() if len(x) <= most_lines else None)
            lengths.append(n.astype(np.int32).tobytes() if len(x) <= most_lines else None)
            many.append(len(x))
        return own, lengths, many

    order = ["u", "doc_id", "quality", "own"]
    got = common.map_text(chosen, order[:3], features, "own binary, lengths binary, lines int").filter("own IS NOT NULL").orderBy(*order).limit(sample)
    # the window is over the sample alone
    running = F.sum("lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = got.withColumn("running", running).filter(F.col("running") <= sample_lines).orderBy(*order).select("own", "lengths", "quality").collect()
    own = [cut_at_limits(np.frombuffer(r["own"], np.float32).reshape(-1, len(LIMITS))) for r in rows]
    model = train(own, [np.frombuffer(r["lengths"], np.int32).astype(np.float64) for r in rows], np.array([r["quality"] for r in rows], float), **options)
    return model._replace(share=counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, score and predicted of every document."""
    scored = common.map_text(docs, ["doc_id", *keep], lambda texts: (scores_of(texts, model),), "score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from the labels outside the held-out fold."""
    rows = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(F.expr(common.crc_is_held_out("doc_id")), F.lit(False)))
    known = labels.select("doc_id", "quality").filter(~F.expr(common.crc_is_held_out("doc_id")))
    return score(rows, fit(rows, known, **options), keep=("held_out",)).select("doc_id", "held_out", "score", "predicted")
