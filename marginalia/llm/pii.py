"""Personal data: patterns, and a character-level BiLSTM-CRF that adds spans.

The base spans are found by patterns in linear time.  A bidirectional LSTM
over characters with CRF transitions, written and trained in numpy, tags every
character of the whole text as outside, or begin or inside of an email, ip,
card or phone.  It runs over windows that overlap; where they do, their tag
scores are averaged, weighted by the distance to the window's edge, and the
text is decoded over the averaged scores, so that no window's edge cuts a
span.  A valid datum has a digit, an @ or a written-out @ in it (`looks_whole`
asks for that), so a window in which, and in whose neighbours, there is none
of these can hold no part of a span that would be added, and is not run.  Runs of characters that are outside by far are not decoded; each
stretch between them is, as a whole, however long.

A span of the tagger is added if it touches no base span, is valid for its
kind, and its probability under the CRF - that of these very tags, from
forward-backward - is at least the model's `sure`.  That bound is set on held-
out windows: the least one at which 97 of 100 added spans are right, where
each span in a window of the corpus that has no datum counts as wrong.

The tagger learns from windows of at most `sample` documents, with their base
spans as labels, and from made-up data set into the corpus's text: the base
forms, and further ones (phone numbers without +, emails with a written-out @
or dot, cards and addresses with other marks between the numbers).

Defined cases: null texts are empty; a text without spans has empty strings
of spans; offsets are code points, end exclusive; repeated rows are alike;
spans of different kinds may overlap, those of one kind do not; of two equally
likely tag sequences the one with the lower tags counts; without any document
the tagger learns from made-up text alone.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 outside, 1 + 2k begin and 2 + 2k inside of kind k.
TAGS = 1 + 2 * len(KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a window for training is laid around, if the text has it.
TRIGGER = re.compile(r"[0-9@]")
#: An @ that is written out: in brackets, or as a word with a dot behind it in the same few words.
WRITTEN_AT = r"[(\[{<]\s?at\s?[)\]}>]|\bat\b[^@]{1,40}?(?:\bdot\b|[a-z0-9]\.[a-z0-9]|[(\[{<]\s?dot\b)"
#: What every valid span has in it.
MUST = re.compile(rf"[0-9@]|{WRITTEN_AT}", re.I | re.A)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, each @ looked at once."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            end = m.end()
        else:
            # what was looked through need not be again: no local part spans an @
            end = at + 1
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    spans = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---------------------------------------------------------------- the tagger

WINDOW, STRIDE = 256, 208
SYMBOLS = 100
#: Windows that are run at a time.
AT_ONCE = 320
#: Characters that are outside with a probability over this in their window are; BESIDE of them stay at each end of a stretch.
OUTSIDE, BESIDE = 0.998, 2
#: Score by which `outside` leads in those.
LEAD = 8.0


def codes_of(text: str) -> np.ndarray:
    """Characters as numbers below SYMBOLS: ASCII apart, other letters and the rest together."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((x >= 32) & (x < 127), x - 32, 95)
    return np.where(x >= 127, 96, out)


class Tagger(NamedTuple):
    embed: np.ndarray  # SYMBOLS x E
    inward: np.ndarray  # 2 x (E + H + 1) x 4H, one LSTM for each direction
    outward: np.ndarray  # (2H + 1) x TAGS
    moves: np.ndarray  # TAGS x TAGS
    sure: float = 0.5  # least probability of an added span


def squash(x: np.ndarray) -> np.ndarray:
    """What stands for the hyperbolic tangent: the same limits, without exponentials.  Its slope is (1 - |squash(x)|) ** 2."""
    return x / (1 + np.abs(x))


def both_ways(x: np.ndarray) -> np.ndarray:
    """Sequences (time, batch, E) and their reverse, as (time, 2, batch, E)."""
    return np.stack([x, x[::-1]], 1)


def lstm(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states of sequences x (time, 2, batch, E), and what the way back needs.

    Gates are input, forget and output, then comes the new value; a gate is
    half of one plus the squashed sum.
    """
    steps, _, batch, size = x.shape
    h_size = w.shape[2] // 4
    fixed = x @ w[:, :size] + w[:, -1:]
    recurrent = w[:, size:-1]
    h, c, out, kept = np.zeros((2, batch, h_size), x.dtype), np.zeros((2, batch, h_size), x.dtype), np.empty((steps, 2, batch, h_size), x.dtype), []
    for t in range(steps):
        s = squash(fixed[t] + h @ recurrent)
        gates = 0.5 + 0.5 * s[..., : 3 * h_size]
        before = c
        c = gates[..., h_size : 2 * h_size] * c + gates[..., :h_size] * s[..., 3 * h_size :]
        tc = squash(c)
        kept.append((h, before, gates, s, tc))
        h = gates[..., 2 * h_size :] * tc
        out[t] = h
    return out, kept


def lstm_back(x: np.ndarray, w: np.ndarray, kept: list, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of w and x, given those of the hidden states."""
    steps, _, batch, size = x.shape
    h_size = w.shape[2] // 4
    dh, dc = np.zeros((2, batch, h_size), x.dtype), np.zeros((2, batch, h_size), x.dtype)
    dz_all, h_all = np.empty((steps, 2, batch, 4 * h_size), x.dtype), np.empty((steps, 2, batch, h_size), x.dtype)
    recurrent = w[:, size:-1].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        h, before, gates, s, tc = kept[t]
        dh = dh + slope[t]
        dc = dc + dh * gates[..., 2 * h_size :] * (1 - np.abs(tc)) ** 2
        dz = dz_all[t]
        dz[..., :h_size], dz[..., h_size : 2 * h_size], dz[..., 2 * h_size : 3 * h_size] = dc * s[..., 3 * h_size :], dc * before, dh * tc
        dz[..., : 3 * h_size] *= 0.5
        dz[..., 3 * h_size :] = dc * gates[..., :h_size]
        dz *= (1 - np.abs(s)) ** 2
        h_all[t] = h
        dh, dc = dz @ recurrent, dc * gates[..., h_size : 2 * h_size]
    flat = dz_all.transpose(1, 0, 2, 3).reshape(2, -1, 4 * h_size)
    flat_x, flat_h = (v.transpose(1, 3, 0, 2).reshape(2, v.shape[3], -1) for v in (x, h_all))
    return np.concatenate([flat_x @ flat, flat_h @ flat, flat.sum(1, keepdims=True)], 1), dz_all @ w[:, :size].transpose(0, 2, 1)


def joined(hidden: np.ndarray) -> np.ndarray:
    """States of both directions (time, 2, batch, H) side by side, in the order of the text."""
    return np.concatenate([hidden[:, 0], hidden[::-1, 1]], 2)


def tag_scores(codes: np.ndarray, m: Tagger) -> np.ndarray:
    """Scores (time, batch, TAGS) of windows (batch, time): lstm() and the layer behind it, without what only the way back needs."""
    size, width = m.embed.shape[1], m.inward.shape[2]
    h_size = width // 4
    table = m.embed @ m.inward[:, :size] + m.inward[:, -1:]
    recurrent = m.inward[:, size:-1]
    batch, steps = codes.shape
    h, c = np.zeros((2, batch, h_size), np.float32), np.zeros((2, batch, h_size), np.float32)
    out = np.empty((2, steps, batch, h_size), np.float32)
    z, more = np.empty((2, batch, width), np.float32), np.empty((2, batch, width), np.float32)
    columns = np.ascontiguousarray(codes.T)
    for t in range(steps):
        np.take(table[0], columns[t], 0, out=z[0], mode="clip")
        np.take(table[1], columns[steps - 1 - t], 0, out=z[1], mode="clip")
        np.matmul(h, recurrent, out=more)
        z += more
        np.abs(z, out=more)
        more += 1
        z /= more
        gates = z[..., : 3 * h_size]
        gates *= 0.5
        gates += 0.5
        c *= gates[..., h_size : 2 * h_size]
        c += gates[..., :h_size] * z[..., 3 * h_size :]
        h = gates[..., 2 * h_size :] * squash(c)
        out[0, t], out[1, steps - 1 - t] = h[0], h[1]
    return out[0] @ m.outward[:h_size] + out[1] @ m.outward[h_size:-1] + m.outward[-1]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_slopes(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of tag sequences (batch, time) with scores (batch, time, TAGS), and its slopes by scores and moves."""
    batch, steps, _ = scores.shape
    top, high = scores.max(2, keepdims=True), moves.max()
    e, m = np.exp(scores - top).transpose(1, 0, 2).copy(), np.exp(moves - high)
    # forward and backward, each step scaled to a sum of 1 forward
    a, b, norm = np.empty_like(e), np.ones_like(e), np.empty((steps, batch, 1), e.dtype)
    now = e[0]
    for t in range(steps):
        if t:
            now = (now @ m) * e[t]
        norm[t] = now.sum(1, keepdims=True)
        now = now / norm[t]
        a[t] = now
    for t in range(steps - 2, -1, -1):
        b[t] = ((e[t + 1] * b[t + 1]) @ m.T) / norm[t + 1]
    p = (a * b).transpose(1, 0, 2).copy()
    behind = (e * b / norm)[1:]
    pairs = np.einsum("tbi,tbj->ij", a[:-1], behind, optimize=True) * m
    z = float(np.log(norm).sum() + top.sum() + batch * (steps - 1) * high)
    rows, cols = np.arange(batch)[:, None], np.arange(steps)[None]
    gold = float(scores[rows, cols, tags].sum() + moves[tags[:, :-1], tags[:, 1:]].sum())
    p[rows, cols, tags] -= 1
    np.subtract.at(pairs, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    return (z - gold) / batch, p / batch, pairs / batch


def allowed() -> np.ndarray:
    """0 where a tag may follow another, a large minus where inside comes without its begin."""
    out = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


#: Characters of a window that one step of the training sees.
SEEN = 64


def train(codes: np.ndarray, tags: np.ndarray, seed: int = 11, rounds: int = 1800, batch: int = 32, hidden: int = 24, size: int = 12, speed: float = 0.02) -> Tagger:
    """Adam on the CRF's likelihood; the gradient goes back through both LSTMs."""
    rng = np.random.default_rng(seed)

    def start(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

    p = [start(SYMBOLS, size) * 4, start(2, size + hidden + 1, 4 * hidden), start(2 * hidden + 1, TAGS), np.zeros((TAGS, TAGS), np.float32)]
    p[1][:, -1] = 0
    p[1][:, -1, hidden : 2 * hidden] = 1  # remember at first
    first, second, rule = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], allowed()
    for k in range(1, rounds + 1):
        pick = rng.integers(0, len(codes), batch)
        at = int(rng.integers(0, codes.shape[1] - SEEN + 1))
        c, y = codes[pick, at : at + SEEN], tags[pick, at : at + SEEN].copy()
        # a cut window may begin inside a span: that is its begin
        y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])
        embed, inward, outward, moves = p
        x = both_ways(embed[c.T])
        states, kept = lstm(x, inward)
        both = joined(states)
        scores = (both @ outward[:-1] + outward[-1]).transpose(1, 0, 2)
        _, ds, dm = crf_slopes(scores, moves + rule, y)
        ds = ds.transpose(1, 0, 2)
        flat, dflat = both.reshape(-1, 2 * hidden), ds.reshape(-1, TAGS)
        d_out = np.vstack([flat.T @ dflat, dflat.sum(0, keepdims=True)])
        d_both = ds @ outward[:-1].T
        d_in, dx = lstm_back(x, inward, kept, np.stack([d_both[:, :, :hidden], d_both[::-1, :, hidden:]], 1))
        hot = np.zeros((SYMBOLS, c.size), np.float32)
        hot[c.T.ravel(), np.arange(c.size)] = 1
        d_embed = hot @ (dx[:, 0] + dx[::-1, 1]).reshape(c.size, size)
        rate = speed * min(1.0, 2 * (1 - k / (rounds + 1)))
        for w, g, m1, m2 in zip(p, (d_embed, d_in, d_out, dm), first, second, strict=True):
            g = np.clip(g, -1, 1)
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w -= (rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return Tagger(p[0], p[1], p[2], p[3] + rule)


EDGE = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def plausible(texts: list[str], model: Tagger) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, in the texts laid end to end, that are not outside by far; their scores; where the texts start.

    Windows go through in order, AT_ONCE at a time, so that memory does not
    grow with a text.  A window's last characters wait for the next one.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    over = WINDOW - STRIDE
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - over) // STRIDE)), 0)
    first = starts.repeat(n) + STRIDE * (np.arange(n.sum()) - (np.cumsum(n) - n).repeat(n))
    last = ends.repeat(n)
    opens = np.zeros(len(first), bool)
    opens[(np.cumsum(n) - n)[n > 0]] = True
    # windows that can hold a part of a valid span: they or their neighbours in the text have what it must have
    must = np.array([m.start() for m in MUST.finditer("".join(texts))], np.int64)
    has = np.searchsorted(must, np.minimum(first + WINDOW, last)) > np.searchsorted(must, first)
    run = has.copy()
    run[1:] |= has[:-1] & ~opens[1:]
    run[:-1] |= has[1:] & ~opens[1:]
    # where a neighbour is not run, a window's own scores count up to its edge
    opens[1:] |= ~run[:-1]
    first, last, opens = first[run], last[run], opens[run]
    codes = np.concatenate([codes_of("".join(texts)).astype(np.int8), np.full(WINDOW, 95, np.int8)])
    places, scores = [np.empty(0, np.int64)], [np.empty((0, TAGS), np.float32)]
    waiting = np.zeros((over, TAGS), np.float32)
    # weights of the two windows over the shared characters, in sum 1
    rise = EDGE[:over] / (EDGE[:over] + EDGE[WINDOW - over :])
    for k in range(0, len(first), AT_ONCE):
        at = first[k : k + AT_ONCE, None] + np.arange(WINDOW)
        inside = at < last[k : k + AT_ONCE, None]
        got = tag_scores(np.where(inside, codes[np.minimum(at, len(codes) - 1)], 95), model).transpose(1, 0, 2)
        opening, closing = opens[k : k + AT_ONCE], np.append(opens, True)[k + 1 : k + 1 + len(at)]
        before = np.concatenate([waiting[None], got[:-1, STRIDE:]])
        waiting = got[-1, STRIDE:].copy()
        shared = got[:, :over] * rise[None, :, None] + before * (1 - rise)[None, :, None]
        got[:, :over] = np.where(opening[:, None, None], got[:, :over], shared)
        # the shared characters behind a window belong to the next one
        inside[:, STRIDE:] &= closing[:, None]
        some = inside & (outside_share(got, model.moves) < OUTSIDE)
        places.append(at[some])
        scores.append(got[some])
    return np.concatenate(places), np.concatenate(scores), starts


def outside_share(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of `outside` of each character of windows (batch, time, TAGS), by forward and backward sums."""
    e = np.exp(scores - scores.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    m = np.exp(moves - moves.max()).astype(np.float32)
    steps = len(e)
    a, b = np.empty_like(e), np.ones_like(e)
    now = a[0] = e[0]
    for t in range(1, steps):
        now = (now @ m) * e[t]
        now /= now.sum(1, keepdims=True)
        a[t] = now
    now = b[-1]
    for t in range(steps - 2, -1, -1):
        now = (now * e[t + 1]) @ m.T
        now /= now.sum(1, keepdims=True)
        b[t] = now
    a *= b
    return (a[:, :, 0] / a.sum(2)).T


def decode(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best tags of stretches laid end to end, logs of forward and backward sums, and of the sum of each stretch.

    Before and behind a stretch is outside.  All stretches go forward
    together, the longest first, so that those still running are a prefix.
    """
    order = np.argsort(-sizes, kind="stable")
    begin, length = starts[order], sizes[order]
    steps = int(length[0]) if len(length) else 0
    running = np.searchsorted(-length, -np.arange(steps), side="left")
    total = len(scores)
    best, a, b = np.empty((total, TAGS)), np.empty((total, TAGS)), np.empty((total, TAGS))
    back = np.zeros((total, TAGS), np.int8)
    for t in range(steps):
        at = begin[: running[t]] + t
        if t == 0:
            best[at] = a[at] = scores[at] + moves[0]
            continue
        way = best[at - 1][:, :, None] + moves
        back[at] = way.argmax(1)
        best[at] = way.max(1) + scores[at]
        a[at] = log_sum(a[at - 1][:, :, None] + moves, 1) + scores[at]
    tags = np.zeros(total, np.int64)
    end = begin + length - 1
    tags[end] = (best[end] + moves[:, 0]).argmax(1)
    b[end] = moves[:, 0]
    z = np.empty(len(sizes))
    z[order] = log_sum(a[end] + b[end], 1)
    for t in range(steps - 2, -1, -1):
        on = begin[: running[t + 1]] + t
        tags[on] = back[on + 1, tags[on + 1]]
        b[on] = log_sum(moves + (scores[on + 1] + b[on + 1])[:, None, :], 2)
    return tags, a, b, z


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of the tagger's spans in each text."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    places, near, starts = plausible(texts, model)
    if not len(places):
        return found
    # neighbours within 2 * BESIDE are one stretch; what lies between and beside is outside by LEAD
    ends = starts + np.array([len(t) for t in texts])
    text_of = np.searchsorted(starts, places, side="right") - 1
    cut = np.append(True, (np.diff(places) > 2 * BESIDE) | (np.diff(text_of) > 0))
    low = np.maximum(places[cut] - BESIDE, starts[text_of[cut]])
    closing = np.append(cut[1:], True)
    high = np.minimum(places[closing] + BESIDE + 1, ends[text_of[closing]])
    sizes = high - low
    begin = np.cumsum(sizes) - sizes
    scores = np.zeros((int(sizes.sum()), TAGS))
    scores[:, 0] = LEAD
    group = np.cumsum(cut) - 1
    scores[begin[group] + places - low[group]] = near
    moves = model.moves.astype(np.float64)
    tags, a, b, z = decode(scores, begin, sizes, moves)
    for at in np.flatnonzero(tags % 2 == 1).tolist():
        g = int(np.searchsorted(begin, at, side="right")) - 1
        stop, inner = int(begin[g] + sizes[g]), int(tags[at]) + 1
        end, sum_ = at + 1, a[at, tags[at]]
        while end < stop and tags[end] == inner:
            sum_ += moves[tags[end - 1], inner] + scores[end, inner]
            end += 1
        then = moves[tags[end - 1]].copy()
        then[inner] = -np.inf
        sum_ += then[0] if end == stop else log_sum((then + scores[end] + b[end])[None], 1)[0]
        k = int(text_of[np.flatnonzero(cut)[g]])
        shift = int(low[g] - begin[g] - starts[k])
        found[k].append((at + shift, (int(tags[at]) - 1) // 2, end + shift, float(np.exp(min(0.0, sum_ - z[g])))))
    return found


#: The area code that a phone number may begin with.
AREA = re.compile(r"\([0-9]{2,5}\)")


def snapped(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The span without marks at its ends, and with the rest of a word or number of which it misses up to three characters."""
    while start < end and not text[start].isalnum():
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    for _ in range(3):
        if 0 < start < end and text[start - 1].isalnum() and text[start].isalnum():
            start -= 1
        if start < end < len(text) and text[end].isalnum() and text[end - 1].isalnum():
            end += 1
    if kind == 3 and start and (text[start - 1] == "+" or AREA.match(text, start - 1)):
        start -= 1
    return start, end


AT, DOT = re.compile(rf"@|{WRITTEN_AT}", re.I | re.A), re.compile(r"\.|\bdot\b", re.I | re.A)


def looks_whole(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a span that the tagger adds is valid for its kind and no part of a longer word or number."""
    if end - start < 7 or (start and text[start - 1].isalnum() and text[start].isalnum()) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()):
        return False
    own = text[start:end]
    digits = "".join(c for c in own if c in "0123456789")
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 1:
        parts = re.findall(r"[0-9]+", own)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 0:
        return bool((m := AT.search(own)) and m.start() and DOT.search(own, m.start() + 2))
    return 7 <= len(digits) <= 15


def added_spans(texts: list[str], base: list[list], model: Tagger, sure: float) -> list[list[tuple[int, int, int, float]]]:
    """Of each text, the tagger's spans that are sure and valid and touch no base span."""
    out = []
    for text, own, more in zip(texts, base, tagged_spans(texts, model), strict=True):
        new, end_of = [], [0] * len(KINDS)
        for s, k, e, p in more:
            if p < sure:
                continue
            s, e = snapped(text, s, k, e)
            if s >= end_of[k] and looks_whole(text, s, k, e) and not any(s < e2 and s2 < e for s2, _, e2 in own):
                new.append((s, k, e, p))
                end_of[k] = e
        out.append(new)
    return out


def all_spans(texts: list[str], model: Tagger | None) -> tuple[list[list], list[list]]:
    """Base spans, and base spans with those that the tagger adds."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return base, base
    return base, [sorted(own + [x[:3] for x in new]) for own, new in zip(base, added_spans(texts, base, model, model.sure), strict=True)]


# ---------------------------------------------------------------- examples


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng: np.random.Generator, low: int, high: int) -> str:
    return "".join(LETTERS[k] for k in rng.integers(0, 26, rng.integers(low, high)))


def digits_of(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def one_of(rng: np.random.Generator, choices):
    return choices[int(rng.integers(0, len(choices)))]


def made_up(rng: np.random.Generator, base: float = 0.5) -> tuple[str, int]:
    """One datum and its kind; with probability 1 - base in a form that the patterns do not know."""
    kind, plain = one_of(rng, (0, 0, 1, 2, 3, 3, 3)), rng.random() < base
    if kind == 0:
        local = word(rng, 2, 9) + (one_of(rng, "._") + word(rng, 2, 7) if rng.random() < 0.4 else "") + (digits_of(rng, int(rng.integers(1, 4))) if rng.random() < 0.4 else "")
        left, right = one_of(rng, ["[]", "()", "{}", "<>"])
        gap = one_of(rng, [" ", " ", ""])
        at, dot = ("@", ".") if plain else one_of(rng, [(f"{gap}{left}at{right}{gap}", f"{gap}{left}dot{right}{gap}"), (f"{gap}{left}at{right}{gap}", "."), (" at ", " dot "), (" AT ", " DOT "), ("@", f"{gap}{left}dot{right}{gap}")])
        name = word(rng, 3, 10) + (digits_of(rng, 1) if rng.random() < 0.2 else "")
        return local + at + name + (dot + word(rng, 3, 8) if rng.random() < 0.4 else "") + dot + one_of(rng, ("com", "org", "net", "de", "fr", "es", "io", "edu")), 0
    if kind == 1:
        mark = "." if plain else one_of(rng, ["[.]", "(.)", " . ", "[dot]"])
        return mark.join(str(x) for x in rng.integers(0, 256, 4)), 1
    if kind == 2:
        number = digits_of(rng, 15)
        number += next(c for c in "0123456789" if luhn(number + c))
        gap = one_of(rng, ["", " ", "-"]) if plain else one_of(rng, [".", "/", "_", " - ", "  "])
        return gap.join(number[k : k + 4] for k in range(0, 16, 4)), 2
    a, b, c, country = digits_of(rng, 3), digits_of(rng, 3), digits_of(rng, 4), str(rng.integers(1, 99))
    if plain:
        return one_of(rng, [f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country}{a}{b}{c}"]), 3
    return one_of(rng, [f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"00{country} {a} {b}{c}", f"(0{a}) {b}{c}", f"0{a}/{b}{c}"]), 3


def plain_number(rng: np.random.Generator) -> str:
    """A number, code or phrase that is no personal datum."""
    n = int(rng.integers(1, 9999))
    code = "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, rng.integers(8, 40)))
    upper = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[k] for k in rng.integers(0, 32, 16))
    day, month, year = f"{n % 28 + 1:02d}", f"{n % 12 + 1:02d}", f"{1900 + n % 130}"
    return one_of(rng, [
        str(n), digits_of(rng, int(rng.integers(5, 12))), f"{n % 10}.{n % 7}", f"{n % 100}%", f"({year})", f"{n:,}", code, f'token = "{code}"', f"AKIA{upper}",
        f"{day}/{month}/{year}", f"{day}.{month}.{year}", f"{year}-{month}-{day}", f"{n % 24:02d}:{n % 60:02d}", f"v{n % 9}.{n % 10}.{n % 10}", f"@{word(rng, 3, 9)}", f"{year}-{n % 2000}",
        f"{word(rng, 3, 8)} at {word(rng, 3, 8)}", f"at {n % 60} {word(rng, 3, 8)}", f"a dot {word(rng, 2, 7)}", f"(at {word(rng, 3, 7)})", f"[{n % 99}]", f"978-{n % 9}-{n % 90 + 10}-{digits_of(rng, 6)}-{n % 10}", f"{n}-{n + 30}", f"{n % 99}.{n % 1000:03d},{n % 100:02d}",
    ])


#: Windows for training and for the threshold, of so many characters.
LENGTH = 128


def examples(windows: list[tuple[str, list]], rng: np.random.Generator, n: int, base: float = 0.5, made: float = 0.45) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """n windows with their spans: a share of `made` with data set in, others with plain numbers set in, others as they are.

    windows: texts of the corpus with their base spans.
    """
    windows = windows or [("the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back", [])]
    out = []
    for _ in range(n):
        text, spans = windows[int(rng.integers(0, len(windows)))]
        way = rng.random()
        if way < made + 0.25:
            words = re.sub(r"\S*[0-9@]\S*", "", text)[: LENGTH + 20].split(" ")
            put = int(rng.integers(0, min(len(words), 12) + 1))
            made_text, spans = " ".join(words[:put]) + " " * bool(put), []
            for _ in range(1 + (rng.random() < 0.25)):
                if way < made:
                    datum, kind = made_up(rng, base)
                    lead = one_of(rng, ["", "", "", "(", ": ", '"', "\n"])
                    made_text += lead
                    spans.append((len(made_text), kind, len(made_text) + len(datum)))
                    made_text += datum + one_of(rng, ["", "", "", ",", ".", ";", ")", '"', "!", "\n"]) + " "
                else:
                    made_text += plain_number(rng) + one_of(rng, ["", "", ",", "."]) + " "
            text = made_text + " ".join(words[put:])
        out.append((text[:LENGTH], [(s, k, min(e, LENGTH)) for s, k, e in spans if s < LENGTH]))
    return out


def tagged(rows: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of windows; shorter ones are filled up with blanks."""
    codes, tags = np.full((len(rows), LENGTH), 95, np.int64), np.zeros((len(rows), LENGTH), np.int64)
    for r, (text, spans) in enumerate(rows):
        part = codes_of(text[:LENGTH])
        codes[r, : len(part)] = part
        for s, k, e in spans:
            tags[r, max(0, s) : e] = 2 + 2 * k
            tags[r, max(0, s)] = 1 + 2 * k
    return codes, tags


def sure_enough(model: Tagger, rows: list[tuple[str, list[tuple[int, int, int]]]], precision: float = 0.97) -> float:
    """The least probability from which on that share of the added spans in windows with known spans is right."""
    texts = [t for t, _ in rows]
    base = [base_spans(t) for t in texts]
    hits = sorted(((p, (s, k, e) in set(gold)) for new, (_, gold) in zip(added_spans(texts, base, model, 0.0), rows, strict=True) for s, k, e, p in new), reverse=True)
    best, right = 1.0, 0
    for n, (p, ok) in enumerate(hits, 1):
        right += ok
        if right >= precision * n:
            best = p
    return max(best, 0.02)


def train_on(windows: list[tuple[str, list]], seed: int, made: int = 12_000, **options) -> Tagger:
    """A tagger from windows of the corpus; every fourth one is held out for the threshold."""
    rng = np.random.default_rng(seed)
    own, held = [w for k, w in enumerate(windows) if k % 4], windows[::4]
    model = train(*tagged(examples(own, rng, made)), seed=seed, **options)
    rows = examples(held, rng, 1500, base=0.2, made=0.7) + [(t, s) for t, s in held if s == base_spans(t)]
    return model._replace(sure=sure_enough(model, rows))


def trained(spark: SparkSession, windows: list[tuple[str, list]], seed: int, **options) -> Tagger:
    """train_on() as one Spark task, whose worker does small products on one thread; the windows are a bounded sample."""

    def work(frames):
        for _ in frames:
            yield pd.DataFrame({"model": [pickle.dumps(tuple(train_on(windows, seed, **options)))]})

    return Tagger(*pickle.loads(spark.range(0, 1, 1, 1).mapInPandas(work, "model binary").first()["model"]))


def cut_windows(text: str) -> list[str]:
    """Two windows of a text, their places drawn by its hash: one around a digit or @ if there is any, one anywhere."""
    draw = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    marks = [m.start() for m in TRIGGER.finditer(text)]
    out = []
    for at in ([marks[draw % len(marks)] - draw % 100] if marks else []) + [draw % max(1, len(text) - LENGTH)]:
        at = max(0, at)
        out.append(text[at : at + LENGTH])
    return out


def fit(docs: DataFrame, sample: int = 1500, seed: int = 11, **options) -> Tagger:
    """A tagger from two windows of LENGTH characters of each of at most `sample` documents."""
    spark = docs.sparkSession
    some = docs.filter("text IS NOT NULL AND text <> ''").select("doc_id", "text")
    share = min(1.0, 4 * sample / max(1, some.count()))
    some = some.filter(F.xxhash64(F.lit(8), "doc_id") <= common.threshold(share)).withColumn("h", F.xxhash64(F.lit(8), "doc_id"))
    cut = common.map_text(some, ["h"], lambda texts: ([cut_windows(t) for t in texts],), "windows array<string>")
    rows = cut.orderBy("h", "windows").limit(sample).collect()
    windows = [(t, base_spans(t)) for r in rows for t in r["windows"]]
    return trained(spark, windows, seed, **options)


COUNTS = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id, numbers of base spans by kind, the hash of the base spans, and all spans."""

    def look(texts):
        base, every = all_spans(texts, model)
        counts = [[sum(s[1] == k for s in own) for own in base] for k in range(len(KINDS))]
        return *counts, [hashlib.sha256(written(own).encode()).hexdigest() for own in base], [written(own) for own in every]

    return common.map_text(docs, ["doc_id"], look, COUNTS, most_chars=1_000_000)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = e
    return "".join([*out, text[at:]])
