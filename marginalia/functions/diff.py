"""Word diffs in Python: the one part whose state does not fit into expressions (DIF-01..04)."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np

from .markdown import PREFIX

TOKEN = re.compile(r"\s+|\w+|[^\w\s]")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+$")


def edits(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """(kind, a from, a to, b from, b to) with kinds equal, delete, insert: a shortest edit script.

    What the other side lacks can't be kept and is left out first.  The rest
    is cut at the middle of a shortest way (Myers 1986, section 4b), and the
    halves again, so that memory grows with the lengths alone.  Where both
    happen at a place, the deletion comes first.
    """
    kept_a, kept_b, x, y = _shared(a, b)
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0

    def change(i2: int, j2: int) -> None:
        if i2 > i:
            out.append(("delete", i, i2, j, j))
        if j2 > j:
            out.append(("insert", i2, i2, j, j2))

    for p, q, n in _kept(x, y):
        # stretches without a gap on either side
        own, other = kept_a[p : p + n], kept_b[q : q + n]
        ends = np.flatnonzero((np.diff(own) != 1) | (np.diff(other) != 1)) + 1
        for f, t in zip([0, *ends.tolist()], [*ends.tolist(), n], strict=True):
            i2, j2 = int(own[f]), int(other[f])
            if (i2, j2) == (i, j) and out and out[-1][0] == "equal":
                out[-1] = ("equal", out[-1][1], i2 + t - f, out[-1][3], j2 + t - f)
            else:
                change(i2, j2)
                out.append(("equal", i2, i2 + t - f, j2, j2 + t - f))
            i, j = i2 + t - f, j2 + t - f
    change(len(a), len(b))
    return out


def _shared(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the tokens that both sides have, and these tokens as numbers."""
    names = dict.fromkeys(a) | dict.fromkeys(b)
    names = dict(zip(names, range(len(names)), strict=True))
    x, y = (np.fromiter(map(names.__getitem__, side), np.int64, len(side)) for side in (a, b))
    there = np.zeros((2, len(names)), bool)
    there[0, x], there[1, y] = True, True
    both = there.all(axis=0)
    at_a, at_b = np.flatnonzero(both[x]), np.flatnonzero(both[y])
    return at_a, at_b, x[at_a], y[at_b]


def _kept(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """(from in x, from in y, length) of what a shortest edit script keeps, in order."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, i2, j, j2 = todo.pop()
        if i2 < 0:  # a stretch that was found before
            out.append((i, j, j2))
            continue
        head = _same(x[i:i2], y[j:j2])
        if head:
            out.append((i, j, head))
        i, j = i + head, j + head
        tail = _same(x[i:i2][::-1], y[j:j2][::-1])
        if tail:
            todo.append((i2 - tail, -1, j2 - tail, tail))
        i2, j2 = i2 - tail, j2 - tail
        if i < i2 and j < j2:
            p, q, n = _middle(x[i:i2], y[j:j2])
            todo.append((i + p + n, i2, j + q + n, j2))
            if n:
                todo.append((i + p, -1, j + q, n))
            todo.append((i, i + p, j, j + q))
    return out


def _same(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning."""
    most, at, step = min(len(x), len(y)), 0, 16
    while at < most:
        end = min(most, at + step)
        unlike = x[at:end] != y[at:end]
        if unlike.any():
            return at + int(unlike.argmax())
        at, step = end, 2 * step
    return most


def _slide(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Move all points (u, v) along their diagonals as far as the tokens agree: most go a few steps, together."""
    live = np.arange(len(u))
    for _ in range(8 if len(u) > 8 else 0):
        live = live[(u[live] < len(x)) & (v[live] < len(y))]
        live = live[x[u[live]] == y[v[live]]]
        if not len(live):
            return
        u[live] += 1
        v[live] += 1
    for k in live:
        n = _same(x[u[k] :], y[v[k] :])
        u[k] += n
        v[k] += n


def _middle(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(from in x, from in y, length) of the stretch in the middle of a shortest way through two unlike sides."""
    n, m = len(x), len(y)
    back_x, back_y = x[::-1], y[::-1]
    most, off = (n + m + 1) // 2, (n + m + 1) // 2 + 1
    ahead, behind = (np.full(2 * off + 2, -1, np.int64) for _ in range(2))
    ahead[off + 1] = behind[off + 1] = 0
    delta = n - m
    for d in range(most + 1):
        # diagonals that leave the box lead nowhere
        k = np.arange(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2)
        for own, other, p, q, forward in ((ahead, behind, x, y, True), (behind, ahead, back_x, back_y, False)):
            right, down = own[off + k - 1] + 1, own[off + k + 1]
            u = np.where((k == -d) | ((k != d) & (right <= down)), down, right)
            u = np.minimum(u, n)
            v = u - k
            from_u = u.copy()
            ok = (v >= 0) & (v <= m) & (u >= 0)
            k_ok, u, v, from_u = k[ok], u[ok], v[ok], from_u[ok]
            _slide(p, q, u, v)
            own[off + k_ok] = u
            if (delta % 2 != 0) == forward:
                facing = delta - k_ok
                reach = d - 1 if forward else d
                near = np.abs(facing) <= reach
                met = np.flatnonzero(near)[u[near] + other[off + facing[near]] >= n]
                met = [t for t in met if other[off + facing[t]] >= 0]
                if met:
                    t = met[0]
                    length = int(u[t] - from_u[t])
                    if forward:
                        return int(from_u[t]), int(from_u[t] - k_ok[t]), length
                    return n - int(u[t]), m - int(v[t]), length
    raise AssertionError("two ways always meet")


def changes(old: str, new: str, by: str = "word") -> list[dict]:
    """DIF-04: replaced, deleted and inserted stretches with their offsets in the old text."""
    split = TOKEN if by == "word" else SENTENCE
    a, b = split.findall(old), split.findall(new)
    if by != "word" and ("".join(a) != old or "".join(b) != new):
        a, b = TOKEN.findall(old), TOKEN.findall(new)
    at = list(accumulate(map(len, a), initial=0))
    out: list[dict] = []
    for kind, i, i2, j, j2 in edits(a, b):
        if kind == "equal":
            continue
        before, after = "".join(a[i:i2]), "".join(b[j:j2])
        last = out[-1] if out else None
        if last and last["end"] == at[i] and ((last["type"], kind) in (("delete", "insert"), ("insert", "delete"))):
            last |= {"type": "replace", "end": at[i2], "old_text": last["old_text"] + before, "new_text": last["new_text"] + after}
        else:
            out.append({"type": kind, "start": at[i], "end": at[i2], "old_text": before, "new_text": after})
    return out


def annotated(old: str, new: str) -> str:
    """DIF-01: the new text with what changed as annotations."""
    out, at = [], 0
    for c in changes(old, new):
        out.append(old[at : c["start"]])
        if c["type"] == "insert":
            out.append("{++" + c["new_text"] + "++}")
        elif c["type"] == "delete":
            out.append("{--" + c["old_text"] + "--}")
        else:
            out.append("{~~" + c["old_text"] + "~>" + c["new_text"] + "~~}")
        at = c["end"]
    return "".join(out) + old[at:]


#: What a line may start with; runs of white space.
MARK, SPACES = re.compile(PREFIX, re.ASCII), re.compile(r"\s+", re.ASCII)


def _first_line(paragraph: str) -> tuple[str, str]:
    """The mark that a paragraph starts with, and the rest of its first line in lower case."""
    line = paragraph.split("\n")[0]
    m = MARK.match(line)
    mark = m[0] if m else ""
    return mark, line[len(mark) :].lower()


def alignment(left: list[str], right: list[str], ahead: int = 3, least: float = 0.3) -> list[tuple[int, int | None, float | None]]:
    """JOIN-15: (left, right, overlap) for each left paragraph, with a cursor over the right ones."""
    out, at = [], 0
    words = [SPACES.split(p.lower()) for p in right]
    for i, p in enumerate(left):
        mark, line = _first_line(p)
        own = set(SPACES.split(line))
        best, partner = least, None
        for j in range(at, min(at + ahead, len(right))):
            share = sum(w in own for w in words[j]) / max(len(own), len(words[j]))
            if share > best:
                best, partner = share, j
        if partner is None and mark and at < len(right) and line[:20] in right[at].lower():
            best, partner = 0.0, at
        out.append((i, partner, None if partner is None else best))
        if partner is not None:
            at = partner + 1
    return out


def paragraphs_annotated(left: list[str], right: list[str], old: list[dict] | None = None, new: list[str] | None = None) -> str:
    """DIF-02 of aligned paragraphs; old (prefix, text) and new are the forms in which pairs are compared, if these are others."""
    out, at = [], 0
    for i, j, _ in alignment(left, right):
        if j is None:
            out.append(left[i] if re.match(r"#{1,6}\s", left[i]) else "{--" + left[i] + "--}")
            continue
        out += ["{++" + p + "++}" for p in right[at:j]]
        before, text = ("", left[i]) if old is None else (old[i]["prefix"], old[i]["text"])
        now = right[j] if new is None else new[j]
        out.append(left[i] if text == now else before + annotated(text, now))
        at = j + 1
    return "\n\n".join([*out, *("{++" + p + "++}" for p in right[at:])])


def single_spaced(text: str) -> str:
    """SCL-02: runs of blanks become one, but for lines that stand in columns.

    A line belongs to an aligned table if it and a line next to it, or within
    the five after it, have gaps of two blanks or more at the same place.
    """
    rows = text.split("\n")
    gaps = [{m.end() for m in re.finditer(r"(?<=\S) {2,}(?=\S)", r)} for r in rows]
    keep = [False] * len(rows)
    for k, own in enumerate(gaps):
        if not own:
            continue
        for n in range(k + 1, min(k + 6, len(rows))):
            if own & gaps[n]:
                keep[k] = keep[n] = True
    return "\n".join(r if k else re.sub(r"(?<=\S) {2,}", " ", r) for r, k in zip(rows, keep, strict=True))


def placed(text: str, comments: list[dict]) -> tuple[str, list[dict]]:
    """DIF-11: comments set behind their anchors; replies behind their parents.

    comments: id, author, text, anchor, before, after, position (share of the
    document), parent.  An anchor that stands in several places goes where its
    context fits best and, of equal ones, nearest to its share; a place is
    used once.  Without an anchor the share alone decides, moved to a blank.
    """
    used: set[int] = set()
    puts: list[tuple[int, int, str]] = []
    report: list[dict] = []
    place_of: dict[str, int] = {}
    lower = text.lower()
    for order, c in enumerate(comments):
        mark = "{>>" + ("↪ " if c.get("parent") else "") + f"{c.get('author') or 'Unknown'}: {c.get('text') or ''}" + "<<}"
        if c.get("parent") in place_of:
            at, how = place_of[c["parent"]], "reply"
        else:
            at, how = _find(text, lower, c, used)
        used.add(at)
        place_of[c["id"]] = at
        puts.append((at, order, mark))
        report.append({"id": c["id"], "strategy": how, "pos": at})
    out, last = [], 0
    for at, _, mark in sorted(puts):
        out += [text[last:at], mark]
        last = at
    return "".join(out) + text[last:], report


def _find(text: str, lower: str, c: dict, used: set[int]) -> tuple[int, str]:
    anchor, share = (c.get("anchor") or "").strip(), c.get("position") or 0.0
    wanted = int(share * len(text))
    words = anchor.lower().split()
    tries = [(anchor.lower(), "direct")] if anchor else []
    for n in (6, 5, 4, 3):
        tries += [(" ".join(words[k : k + n]), "partial") for k in range(len(words) - n + 1) if len(" ".join(words[k : k + n])) >= 15]
    for needle, how in tries:
        hits, k = [], lower.find(needle)
        while k >= 0:
            hits.append(k)
            k = lower.find(needle, k + 1)
        free = [h for h in hits if h + len(needle) not in used] or hits
        if free:
            best = max(free, key=lambda h: (_context(lower, h, len(needle), c), -abs(h - wanted)))
            return best + len(needle), how
    near = text.find(" ", min(wanted, len(text)))
    return (near if 0 <= near - wanted <= 50 else min(wanted, len(text))), "position-only"


def _context(lower: str, at: int, n: int, c: dict) -> int:
    before, after = (c.get("before") or "").lower(), (c.get("after") or "").lower()
    left, right = lower[max(0, at - len(before) - 20) : at], lower[at + n : at + n + len(after) + 20]
    score = sum(2 for w in before.split() if len(w) > 3 and w in left) + sum(2 for w in after.split() if len(w) > 3 and w in right)
    return score + (5 if before and before[-30:] in left else 0) + (5 if after and after[:30] in right else 0)
