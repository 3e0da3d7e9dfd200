"""Quality rules under weak supervision.

Each rule looks at statistics of a whole text and votes good (1), bad (-1)
or abstains (0).  A naive Bayes label model over the votes is fitted by
expectation-maximisation: it estimates, for each rule, how it votes on good
and on bad documents, and so its accuracy.  A document is kept if its
posterior probability of quality is at least `keep`, instead of only when
all rules pass.

The model is fitted on the counts of the vote patterns of all documents; of
those there are at most 3 ** len(RULES), whatever the number of documents.

Defined cases: a null or blank text has no words, its ratios are 0 and it
fails the base rules; an empty table gives an empty result; repeated rows
are judged alike; a text's length only matters as a number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Marks that a plain word may have around it.
MARKS = ".,;:!?\"'()«»“”’"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_closed_lines long, n_upper long, n_letters long, n_shouts long, n_distinct long, longest long, n_plain long"


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name -> vote, over the columns of STATS."""
    n, many = F.col("n_words"), F.col("n_words") >= 30
    repeated, doubled = ratio("n_repeat_words", "n_words"), ratio("n_dup_lines", "n_lines")
    symbols, upper = ratio("n_symbols", "word_chars"), ratio("n_upper", "n_letters")
    length, shouts = ratio("word_chars", "n_words"), ratio("n_shouts", "n_words")
    distinct, closed = ratio("n_distinct", "n_words"), ratio("n_closed_lines", "n_lines")
    plain, marked = ratio("n_plain", "n_words"), ratio("n_symbols", "n_words")
    return {
        "length": vote(n, n >= 80, n < 20),
        "repeated_words": vote(repeated, many & (repeated < 0.1), repeated > 0.3),
        "repeated_lines": vote(doubled, (F.col("n_lines") >= 4) & (doubled < 0.1), doubled > 0.3),
        "symbols": vote(symbols, many & (symbols < 0.004), symbols > 0.03),
        "word_length": vote(length, many & length.between(3.5, 9), (n > 0) & ~length.between(2, 15)),
        "upper_case": vote(upper, many & (upper < 0.12), upper > 0.3),
        "exclamation": vote(shouts, many & (shouts < 0.02), shouts > 0.1),
        "distinct_words": vote(distinct, many & (n <= 2000) & (distinct > 0.35), many & (distinct < 0.1)),
        "closed_lines": vote(closed, many & (closed > 0.7), many & (closed < 0.2)),
        "plain_words": vote(plain, many & (plain > 0.9), (n >= 5) & (plain < 0.6)),
        "marked_words": vote(marked, F.lit(False), marked > 0.25),
        "long_words": vote(F.col("longest"), F.lit(False), F.col("longest") > 200),
    }


def words_of(text: str) -> list[str]:
    for c in SPACES:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def repeat_words(codes: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    if len(codes) < 3:
        return 0
    pairs = codes[:-1] * kinds + codes[1:]
    if kinds > 2_000_000:  # three numbers would not fit into 63 bits, so pairs are numbered anew
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs[:-1] * kinds + codes[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    words = words_of(text)
    number: dict[str, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    seen: set[str] = set()
    lines = doubled = closed = 0
    for line in text.split("\n"):
        if bare := line.strip(" " + SPACES):
            lines += 1
            doubled += line in seen
            seen.add(line)
            closed += bare[-1] in ".!?:;\"'”»)"
    uses = np.bincount(codes, minlength=len(number))
    plain = int(sum(u for w, u in zip(number, uses, strict=True) if w.strip(MARKS).isalpha()))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    blank = sum(map(text.count, " " + SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), len(text) - blank, symbols, doubled, repeat_words(codes, len(number)), lines, closed, upper, upper + lower, text.count("!"), len(number), max(map(len, number), default=0), plain


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS, one row per document (doc_id, text)."""

    def measure(texts):
        return list(zip(*map(statistics, texts), strict=True))

    return common.map_text(docs, ["doc_id"], measure, STATS)


#: What is believed of a rule beforehand: how often it votes bad, abstains, votes good on bad and on good documents.
BELIEF = ((0.4, 0.1, 0.5), (0.02, 0.38, 0.6))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, weight: float = 0.25) -> tuple[float, np.ndarray]:
    """Prior of quality and p[rule, class, vote + 1], by expectation-maximisation.

    The belief that rules are mostly right counts as much as `weight` times
    the documents.  It fixes which of the two classes is the good one and
    keeps a rare defect, seen by one rule only, from being learnt as normal.
    """
    n_rules = patterns.shape[1]
    belief = np.repeat(np.array(BELIEF)[None], n_rules, axis=0)
    prior, p, extra = 0.8, belief, weight * counts.sum() + 1.0
    hit = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        post = posterior(prior, p, patterns)
        weights = np.stack([(1 - post) * counts, post * counts])
        new = (np.einsum("cn,nrv->rcv", weights, hit) + extra * belief) / (weights.sum(1)[None, :, None] + extra)
        shift, p = np.abs(new - p).max(), new
        prior = float((weights[1].sum() + 4) / (counts.sum() + 5))
        if shift < 1e-6:
            break
    return prior, p


def posterior(prior: float, p: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    r = np.arange(patterns.shape[1])
    odds = np.log(prior / (1 - prior)) + (np.log(p[r, 1, patterns + 1]) - np.log(p[r, 0, patterns + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def accuracies(prior: float, p: np.ndarray) -> np.ndarray:
    """Of each rule: how often a vote of it is right."""
    right, wrong = prior * p[:, 1, 2] + (1 - prior) * p[:, 0, 0], prior * p[:, 1, 0] + (1 - prior) * p[:, 0, 2]
    return right / (right + wrong)


def judge(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """STATS, votes, base_failed, posterior and kept of every document."""
    voted = common.materialize(with_statistics(docs).select("*", *[v.cast("int").alias(f"vote_{k}") for k, v in rules().items()]), "votes")
    names = [f"vote_{k}" for k in rules()]
    rows = voted.groupBy(*names).count().collect()
    patterns = np.array([r[:-1] for r in rows], np.int64).reshape(len(rows), len(names))
    prior, p = fit(patterns, np.array([r[-1] for r in rows], float))
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for k, c in enumerate(names):
        bad, none, good = (float(x) for x in np.log(p[k, 1]) - np.log(p[k, 0]))
        odds = odds + F.when(F.col(c) > 0, good).when(F.col(c) < 0, bad).otherwise(none)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep))
