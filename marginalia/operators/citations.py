"""Citations and bibliographies (EXT-08, SRC-04, JOIN-01..03, AGG-02/03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_doi, chain, for_matching, is_doi, is_supplement, strip
from .lines import lines

#: The citation grammars.
BRACKET = r"\[@([^\]]+)\]"
INLINE = r"(?<!\[)@([A-Za-z][A-Za-z0-9_-]*\d{4}[a-z]?)(?![;\]])"
ENTRY_KEY = r"@[A-Za-z0-9_]+\s*\{\s*([^,\s]+)\s*,"
#: Entry types that need no DOI, and those that should have one.
NO_DOI_TYPES = ("book", "inbook", "thesis", "mastersthesis", "phdthesis", "misc", "unpublished", "manual", "techreport", "booklet")
EXPECT_DOI_TYPES = ("article", "inproceedings", "proceedings", "incollection")
#: Scores from which a match is of high or medium confidence, and the lead it needs to be high.
HIGH, MEDIUM, LEAD = 120, 70, 30


def citations(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per citation: kept columns, line, key.  Lines that start a fence or a comment are skipped."""
    text = lines(docs, *keep).filter(~strip("line_text").startswith("```") & ~strip("line_text").startswith("<!--"))
    groups = F.explode(F.regexp_extract_all("line_text", F.lit(BRACKET), F.lit(1)))
    bracket = text.filter(F.contains("line_text", F.lit("[@"))).select(*keep, "line", groups.alias("g"))
    bracket = bracket.select(*keep, "line", F.explode(F.split("g", ";")).alias("key")).withColumn("key", chain(strip("key"), ("^@", ""))).filter("key <> ''")
    inline = text.filter(F.contains("line_text", F.lit("@"))).select(*keep, "line", F.explode(F.regexp_extract_all("line_text", F.lit(INLINE), F.lit(1))).alias("key"))
    return bracket.unionByName(inline)


def bibliography_keys(texts: DataFrame) -> DataFrame:
    """SRC-04: distinct entry keys of bibliography texts."""
    return texts.select(F.explode(F.regexp_extract_all("text", F.lit(ENTRY_KEY), F.lit(1))).alias("key")).distinct()


def valid(cited: DataFrame, bib: DataFrame) -> DataFrame:
    return cited.join(bib, "key", "left_semi")


def missing(cited: DataFrame, bib: DataFrame) -> DataFrame:
    return cited.join(bib, "key", "left_anti")


def unused(cited: DataFrame, bib: DataFrame) -> DataFrame:
    return bib.join(cited.select("key").distinct(), "key", "left_anti")


def duplicates(cited: DataFrame) -> DataFrame:
    """AGG-03: keys cited more than once, with how often."""
    return cited.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_uses(cited: DataFrame) -> DataFrame:
    """AGG-03: the citations of keys that are cited more than once, a row each with the number: no key's places are gathered in one task."""
    return cited.join(duplicates(cited), "key")


def appended(found: DataFrame, more: DataFrame, doi: str = "doi") -> DataFrame:
    """SET-05: all that was found, and of the other answers those whose DOI is not there yet, once each.

    DOIs are compared without case and resolver prefix; answers without one
    are never there yet.
    """
    name = F.lower(bare_doi(doi))
    there = found.select(name.alias("_doi")).filter("_doi IS NOT NULL").distinct()
    fresh = more.withColumn("_doi", name).join(there, "_doi", "left_anti")
    whole = F.struct(*[F.col(c) for c in more.columns])
    one = fresh.filter("_doi IS NOT NULL").groupBy("_doi").agg(F.min(whole).alias("_row")).select("_row.*")
    return found.unionByName(one.select(*more.columns)).unionByName(fresh.filter("_doi IS NULL").select(*more.columns))


def statistics(cited: DataFrame, bib: DataFrame) -> DataFrame:
    """AGG-02: one row.  Citations are counted per key first, so that the join moves keys only."""
    per_key = cited.groupBy("key").agg(F.count("*").alias("n"))
    both = per_key.join(bib.withColumn("there", F.lit(True)), "key", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count("n").alias("unique_keys"),
        F.coalesce(F.sum(F.when(F.col("there"), F.col("n"))), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(F.col("there").isNull()).alias("missing_keys"),
        F.count("there").alias("bib_entries"),
        F.count_if(F.col("n").isNull()).alias("unused"),
    )


def doi_status(entries: DataFrame) -> DataFrame:
    """AGG-07, FLT-04: each entry with what its DOI field says; columns key, type, doi, skip."""
    d = bare_doi("doi")
    status = (
        F.when(F.col("skip"), "skipped")
        .when(F.coalesce(d, F.lit("")) == "", F.when(F.col("type").isin(*NO_DOI_TYPES), "skipped").otherwise("missing"))
        .when(is_doi(d), "valid")
        .otherwise("invalid")
    )
    return entries.withColumn("doi", d).withColumn("status", status).withColumn("expects_doi", F.col("type").isin(*EXPECT_DOI_TYPES))


def _long_words(c: Column, n: int) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > n)


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.filter(a, lambda w: F.exists(b, lambda v: F.contains(v, w) | F.contains(w, v))))


def _spoken(c: Column | str) -> Column:
    """A name as scores compare it."""
    return F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _by_kind(doi: str, title: str, journal: str) -> Column:
    return F.when(is_supplement(doi, title, journal), -100.0).otherwise(0.0)


def _by_title(t: Column, it: Column) -> Column:
    tw, iw = _long_words(t, 3), _long_words(it, 3)
    return F.when(it == t, 100.0).when(F.contains(it, t) | F.contains(t, it), 50.0).otherwise(_overlap(tw, iw) / F.greatest(F.size(tw), F.lit(1)) * 40)


def _by_author(a: Column, b: Column) -> Column:
    return F.when((a != "") & (F.contains(b, a) | F.contains(a, b)), 30.0).otherwise(0.0)


def _by_journal(j: Column, ij: Column) -> Column:
    jw = _long_words(j, 2)
    shared = _overlap(jw, _long_words(ij, 2))
    return F.when((j != "") & (ij != ""), F.when(shared >= F.least(F.lit(2), F.size(jw)), 40.0).when(shared >= 1, 15.0).otherwise(0.0) + F.when(j == ij, 20.0).otherwise(0.0)).otherwise(0.0)


def _by_year(year: Column, item_year: Column) -> Column:
    apart = F.abs(item_year - year)
    return F.when(year.isNull(), 0.0).when(item_year.isNull(), -10.0).when(apart == 0, 50.0).when(apart == 1, 20.0).otherwise(-50.0)


def match_score(title: str, journal: str, year: str, author: str, item_title: str, item_journal: str, item_year: str, item_doi: str, item_surname: str, base: str) -> Column:
    """JOIN-19: how well a found work fits a wanted one."""
    t, it, j, ij = (for_matching(c) for c in (title, item_title, journal, item_journal))
    by_author = _by_author(_spoken(author), _spoken(item_surname))
    return _by_kind(item_doi, item_title, item_journal) + _by_title(t, it) + by_author + _by_journal(j, ij) + _by_year(F.col(year), F.col(item_year)) + F.least(F.coalesce(F.col(base), F.lit(0.0)), F.lit(10.0))


def _titles_met(wanted: DataFrame, works: DataFrame, title: str, item_title: str) -> DataFrame:
    """Pairs of different titles, made for matching, that share a word of more than three letters: title, item_title."""
    a, b = (df.select(c).distinct().select(c, F.explode(F.array_distinct(_long_words(F.col(c), 3))).alias("_word")) for df, c in ((wanted, title), (works, item_title)))
    return a.join(b, "_word").select(title, item_title).distinct()


def candidates(wanted: DataFrame, works: DataFrame, title: str = "title", item_title: str = "item_title") -> DataFrame:
    """JOIN-19: pairs of a wanted work and a known one whose titles share a word of more than three letters, once each.

    Different titles meet by equal words, then rows by titles; the keys of
    wanted and works are all their columns.
    """
    a, b = wanted.distinct().withColumn("_title", for_matching(title)), works.distinct().withColumn("_item_title", for_matching(item_title))
    return a.join(_titles_met(a, b, "_title", "_item_title"), "_title").join(b, "_item_title").drop("_title", "_item_title")


def _leading(scored: DataFrame, by: list[str], most: int) -> DataFrame:
    """The rows of each group that may be among its first `most` by score and DOI when all its scores have grown by the same.

    Scores that lie so near that a sum may round them to one are all kept.
    """
    alike, level = Window.partitionBy(*by, "score").orderBy("doi"), Window.partitionBy(*by).orderBy(F.desc(F.rint(F.col("score") * 1e6)))
    few = scored.withColumn("_n", F.row_number().over(alike)).filter(F.col("_n") <= most)
    return few.withColumn("_n", F.rank().over(level)).filter(F.col("_n") <= most).drop("_n")


def best_known(wanted: DataFrame, works: DataFrame, top: int = 1) -> DataFrame:
    """JOIN-19: the best of all works for each wanted one (query_key, title, journal, author, year), as `best_matches` has them.

    works: doi, item_title, item_journal, item_author, item_year.  A score is
    a sum of what titles, authors, journals and years say, so the terms are
    added one after the other: wanted ones that say the same so far are looked
    up once, and of works that say the same in all the terms to come only
    those go on that can still be in the result or its last one's runner-up.
    All pairs are made only where no two works agree in what is to come.
    """
    most, asked = top + 1, {"title": for_matching, "author": _spoken, "journal": for_matching, "year": F.col}
    wanted = wanted.select("query_key", *[f(c).alias(f"_{c}") for c, f in asked.items()])
    few = works.select("doi", *[f"item_{c}" for c in asked]).distinct()
    few = few.select("doi", *[f(f"item_{c}").alias(f"_item_{c}") for c, f in asked.items()], _by_kind("doi", "item_title", "item_journal").alias("score"))
    own, items = [f"_{c}" for c in asked], [f"_item_{c}" for c in asked]
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy(*items, "score").orderBy("doi"))).filter(F.col("_n") <= most).drop("_n")
    # few bytes make many pairs, so the number of tasks is not left to sizes
    n = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    titles = _titles_met(wanted, few, "_title", "_item_title").withColumn("_more", _by_title(F.col("_title"), F.col("_item_title")))
    found = few.repartition(n, "doi").join(titles, "_item_title").withColumn("score", F.col("score") + F.col("_more")).drop("_more", "_item_title")
    found = _leading(found, ["_title", *items[1:]], most)
    for k, term in enumerate((_by_author, _by_journal, _by_year), 1):
        said = wanted.select(*own[: k + 1]).distinct()
        found = found.join(said, own[:k]).withColumn("score", F.col("score") + term(F.col(own[k]), F.col(items[k]))).drop(items[k])
        found = _leading(found, [*own[: k + 1], *items[k + 1 :]], most)
    best = best_matches(found.select(F.struct(*own).alias("_asked"), "doi", "score"), "_asked", top)
    return wanted.join(best, F.struct(*own).eqNullSafe(F.col("_asked"))).select("query_key", "doi", "score", "rank", "runner_up", "confidence")


def best_matches(scored: DataFrame, query: str = "query_key", top: int = 1) -> DataFrame:
    """WIN-08: the best found work of each query, its lead and confidence."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "doi")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("runner_up", F.lead("score").over(w))
    lead = F.col("score") - F.coalesce("runner_up", F.lit(0.0))
    sure = F.when((F.col("score") >= HIGH) & (F.col("runner_up").isNull() | (lead >= LEAD)), "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return ranked.withColumn("confidence", sure).filter(F.col("rank") <= top)


def confident(found: DataFrame, at_least: str) -> DataFrame:
    """FLT-03."""
    rank = {"low": 1, "medium": 2, "high": 3}
    own = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    return found.filter(own >= rank[at_least])
