"""Comment anchors in texts: candidates, context scores, quality (SCL-28..32, EXT-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import bound, chain, col, running, strip

#: Least length of a partial anchor, and its words from most to least.
PARTIAL, WINDOWS = 15, (6, 5, 4, 3)
#: Where anchors are cut into parts, and the number of places from which on a part says nothing.
SEPARATORS, RARE = (" ", ", ", ". ", " - ", " – "), 5


def occurrences(text: Column | str, needle: Column | str) -> Column:
    """EXT-31: offsets of all, also overlapping, occurrences, in one scan of the text.

    The text is cut in front of every occurrence; an occurrence stands where
    the lengths of the pieces before it end.
    """
    t, n = col(text), col(needle)
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    lengths = F.transform(F.split(t, quoted, F.lit(-1)), F.length)
    starts = running(lengths)
    found = F.when(F.startswith(t, n), starts).otherwise(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))))
    return F.when((F.length(n) == 0) | ~F.contains(t, n), F.array().cast("array<int>")).otherwise(found)


def first_at(text: Column | str, needle: Column | str) -> Column:
    """Offset of the first occurrence, -1 if there is none."""
    return F.instr(col(text), col(needle)) - 1


def context_score(pos: Column | str, text: Column | str, before: Column | str, after: Column | str, length: Column | str) -> Column:
    """SCL-28: 2 for each long word of the context found near, 5 for its near end as a whole."""
    p, t, b, a, n = map(col, (pos, text, before, after, length))

    def words(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 3)

    start = F.greatest(p - F.length(b) - 20, F.lit(0))
    left = F.lower(F.substr(t, start + 1, p - start))
    right = F.lower(F.substr(t, p + n + 1, F.length(a) + 20))
    by_left = 2 * F.size(F.filter(words(b), lambda w: F.contains(left, w))) + F.when(F.contains(left, F.right(F.lower(b), F.lit(30))), 5).otherwise(0)
    by_right = 2 * F.size(F.filter(words(a), lambda w: F.contains(right, w))) + F.when(F.contains(right, F.left(F.lower(a), F.lit(30))), 5).otherwise(0)
    return F.when(F.coalesce(b, F.lit("")) == "", 0).otherwise(by_left) + F.when(F.coalesce(a, F.lit("")) == "", 0).otherwise(by_right)


def normalized(c: Column | str) -> Column:
    return chain(c, (r"\s+", " "))


def _hit(name: Column | str, matched: Column, positions: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("strategy"), matched.cast("string").alias("matched"), positions.cast("array<int>").alias("positions"))


def _no_hit(name: str) -> Column:
    return _hit(name, F.lit(None), F.array())


def _bracketed(lt: Column, before: Column, after: Column, most: Column, least: Column, failed: Column | None) -> Column:
    """The place between the end of `before` and the next beginning of `after`, if the gap is from `least` to `most`.

    Where both stand but the gap is of another size, the result is `failed`, if given.
    """
    b, a = F.right(before, F.lit(50)), F.left(after, F.lit(50))
    start = F.when(F.contains(lt, b), F.instr(lt, b) - 1 + F.length(b))

    def gap(s: Column) -> Column:
        between = F.call_function("locate", a, lt, s + 1) - 1 - s
        fits = F.when((between >= least) & (between <= most), _hit("context-both", F.lit(None), F.array(s)))
        return fits if failed is None else F.when(between >= 0, F.coalesce(fits, failed))

    return F.when((before != "") & (after != "") & start.isNotNull(), bound(start, gap))


def _one_sided(lt: Column, before: Column, after: Column) -> list[Column]:
    """Behind the last place of what stood before; else at the first place of what stood after."""
    b, a = F.right(before, F.lit(30)), F.left(after, F.lit(30))
    behind = F.length(lt) - F.length(F.call_function("substring_index", lt, b, F.lit(-1)))
    return [
        F.when((before != "") & F.contains(lt, b), _hit("context-before", F.lit(None), F.array(behind))),
        F.when((after != "") & F.contains(lt, a), _hit("context-after", F.lit(None), F.array(first_at(lt, a)))),
    ]


def _window(a: Column, lt: Column, bt: Column) -> Column:
    """A run of six to three words of an anchor of more than three, in the text or in the text without markup."""
    words = F.split(a, r"\s+", -1)

    def runs(n: int) -> Column:
        all_of_n = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, k + 1, F.lit(n)), " ").alias("w")))
        return F.when((F.size(words) > 3) & (F.size(words) >= n), all_of_n).otherwise(F.array().cast("array<struct<k: int, w: string>>"))

    fit = F.filter(F.flatten(F.array(*map(runs, WINDOWS))), lambda r: (F.length(r["w"]) >= PARTIAL) & (F.contains(lt, F.lower(r["w"])) | F.contains(bt, F.lower(r["w"]))))

    def hit(r: Column) -> Column:
        w = F.lower(r["w"])
        name = F.when(r["k"] == 0, "partial-start").otherwise("partial-window")
        plain = F.contains(lt, w)
        return F.when(r.isNotNull(), _hit(F.concat(name, F.when(plain, "").otherwise("-stripped")), r["w"], occurrences(F.when(plain, lt).otherwise(bt), w)))

    return bound(F.get(fit, F.lit(0)), hit)


def _parts(a: Column, lt: Column) -> Column:
    """The first part of the anchor, of four characters on, that stands in fewer than `RARE` places."""
    cut = [F.when(F.contains(a, F.lit(sep)), F.split(a, rf"\Q{sep}\E", -1)).otherwise(F.array().cast("array<string>")) for sep in SEPARATORS]
    long = F.array_distinct(F.filter(F.flatten(F.array(*cut)), lambda p: F.length(p) >= 4))
    placed = F.transform(long, lambda p: F.struct(p.alias("p"), occurrences(lt, F.lower(p)).alias("at")))
    return bound(F.get(F.filter(placed, lambda x: F.size(x["at"]).between(1, RARE - 1)), F.lit(0)), lambda x: F.when(x.isNotNull(), _hit("split-match", x["p"], x["at"])))


def found(anchor: Column | str, text: Column | str, before: Column | str | None = None, after: Column | str | None = None) -> Column:
    """SCL-29: where an anchor is, struct<strategy, matched, positions>, by the first of six ways that hits.

    direct: as it is, in any case of letters; normalized: with runs of white
    space as one blank; stripped: in the text without markup; partial-...: a
    run of its words; context-...: between, behind or before what surrounded
    it (the gap from 30 % of the anchor's length to twice it and 50, at most
    500; both sides with another gap mean that it was deleted); split-match: a
    rare part of it.  An empty anchor goes by context alone, with a gap below
    500.  Positions of `normalized` and `...stripped` are of those forms of
    the text.  Later ways are only computed where earlier ones failed.
    """
    a, t = F.coalesce(col(anchor), F.lit("")), F.coalesce(col(text), F.lit(""))
    b, f = (F.lower(F.coalesce(F.lit(None) if c is None else col(c), F.lit(""))) for c in (before, after))
    n = F.length(a)

    def within(lt: Column) -> Column:
        la = F.lower(a)
        nt, na = normalized(lt), normalized(la)

        def bare(bt: Column) -> Column:
            both = _bracketed(lt, b, f, F.least(F.lit(500), 2 * n + 50), F.floor(n * 0.3), _no_hit("failed"))
            return F.coalesce(F.when(F.contains(bt, la), _hit("stripped", a, occurrences(bt, la))), _window(a, lt, bt), both, *_one_sided(lt, b, f), _parts(a, lt), _no_hit("failed"))

        empty = F.coalesce(_bracketed(lt, b, f, F.lit(499), F.lit(0), None), *_one_sided(lt, b, f), _no_hit("empty-anchor"))
        return (
            F.when(strip(a) == "", empty)
            .when(F.contains(lt, la), _hit("direct", a, occurrences(lt, la)))
            .when(F.contains(nt, na), _hit("normalized", a, F.array(first_at(nt, na))))
            .otherwise(bound(F.lower(markup.stripped(t)), bare))
        )

    return bound(F.lower(t), within)


def strategy(anchor: Column | str, text: Column | str) -> Column:
    """How an anchor is found in a text without its context, struct<strategy, pos>; partial ones under one name."""
    def short(x: Column) -> Column:
        name = F.when(x["strategy"].startswith("partial"), "partial").when(x["strategy"] == "empty-anchor", "empty").otherwise(x["strategy"])
        return F.struct(name.alias("strategy"), F.coalesce(F.get(x["positions"], F.lit(0)), F.lit(-1)).alias("pos"))

    return bound(found(anchor, text), short)


def located(comments: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """SCL-29 over tables: comments (key, anchor, before, after and others) with strategy, matched, positions.

    A text goes once to the list of its comments, not once to each of them.
    """
    rest = [c for c in comments.columns if c != key]
    lists = comments.groupBy(key).agg(F.collect_list(F.struct(*rest)).alias("_comments"))
    met = lists.join(texts.select(F.col(key).alias("_key"), F.col("text").alias("_text")), F.col(key).eqNullSafe(F.col("_key")))
    each = F.transform("_comments", lambda c: F.struct(c.alias("c"), found(c["anchor"], F.col("_text"), c["before"], c["after"]).alias("f")))
    return met.select(key, F.inline(each)).select(key, "c.*", "f.*")


def quality(name: Column | str) -> Column:
    """SCL-30."""
    s = col(name)
    return F.when(s.isin("direct", "normalized"), "clean").when(s == "stripped", "drift").when(s.startswith("partial") | s.startswith("split"), "drift").when(s.startswith("context"), "context-only").otherwise("unmatched")


def confidence(name: Column | str) -> Column:
    """SCL-31."""
    return F.when(col(name).rlike("proportional|position-only|context"), "low").otherwise("high")


def proportional(doc_position: Column | str, doc_length: Column | str, text: Column | str) -> Column:
    """SCL-32: an offset by the share of the document that lies before, moved to the next blank within 50 characters."""
    at = F.when(col(doc_length) > 0, F.floor(F.length(col(text)) * col(doc_position) / col(doc_length))).otherwise(0).cast("int")
    near = F.regexp_instr(F.substr(col(text), at + 1, F.lit(50)), F.lit(r"\s"))
    return F.when(near > 0, at + near - 1).otherwise(at)


def snapped(text: Column | str, pos: Column | str, reach: int = 50) -> Column:
    """SCL-32: the nearest white space within reach of an offset, of two equally near ones the later; else the offset itself."""
    t, p = col(text), col(pos)
    n = F.length(t)
    ahead = F.regexp_instr(F.substr(t, p + 1, F.lit(reach + 1)), F.lit(r"\s")) - 1
    start = F.greatest(p - reach, F.lit(0))
    back = F.regexp_instr(F.reverse(F.substr(t, start + 1, p - start)), F.lit(r"\s"))
    nearest = F.when((ahead >= 0) & ((back == 0) | (ahead <= back)), p + ahead).when(back > 0, p - back).otherwise(p)
    return F.when(p <= 0, 0).when(p >= n, n).otherwise(nearest)


def past_heading(text: Column | str, pos: Column | str) -> Column:
    """SCL-32: an offset before the end of the first heading moves to the beginning of the text below it."""
    t, p = col(text), col(pos)
    heading = r"(?m)^#{1,6}\s.+$"
    at = F.regexp_instr(t, F.lit(heading)) - 1
    end = at + F.length(F.regexp_extract(t, heading, 0))
    below = end + F.length(F.regexp_extract(F.substr(t, end + 1), r"^[\r\n]*", 0))
    return F.when(at < 0, p).when((p > 0) & (p >= end), p).otherwise(below)
