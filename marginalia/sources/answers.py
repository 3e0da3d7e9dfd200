"""Answers of reference registries as tables (SRC-24): rows of JSON, asked for elsewhere, as works, people and verdicts.

A row whose JSON is null or broken has no works, and is `unreachable` where a verdict is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bare_doi, bare_orcid, is_doi, is_orcid, strip
from ..operators.citations import doi_status

_DATE = "struct<`date-parts`:array<array<int>>>"
#: The parts of the answers that count.
CROSSREF = f"struct<message:struct<items:array<struct<DOI:string,title:array<string>,author:array<struct<family:string,given:string>>,`container-title`:array<string>,`published-print`:{_DATE},`published-online`:{_DATE},score:double,type:string>>>>"
DATACITE = "struct<data:array<struct<id:string,attributes:struct<titles:array<struct<title:string>>,creators:array<struct<familyName:string,givenName:string>>,publicationYear:int,publisher:string>>>>"
PERSON = (
    "struct<name:struct<`given-names`:struct<value:string>,`family-name`:struct<value:string>>,emails:struct<email:array<struct<email:string,primary:boolean>>>,"
    "employments:struct<`affiliation-group`:array<struct<summaries:array<struct<`employment-summary`:struct<organization:struct<name:string>>>>>>>>"
)
WORK = f"struct<type:string,publisher:string,author:array<struct<family:string,given:string,familyName:string,givenName:string>>,issued:{_DATE},published:{_DATE},created:{_DATE}>"
#: Score that works of the second registry start with.
DATACITE_BASE = 50.0


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _year(date: Column) -> Column:
    return F.nullif(_first(_first(date["date-parts"])), F.lit(0))


def _works(rows: DataFrame, keep: tuple[str, ...], source: str, items: Column, fields) -> DataFrame:
    each = rows.select(*keep, F.posexplode(items).alias("n", "x"))
    return each.select(*keep, F.lit(source).alias("source"), "n", *fields(F.col("x")))


def crossref(rows: DataFrame, *keep: str, column: str = "json") -> DataFrame:
    """The works of a search's answers in their order: source, n, doi, item_title, item_author, item_journal, item_year, base."""
    return _works(rows, keep, "crossref", F.from_json(column, CROSSREF)["message"]["items"], lambda x: (
        x["DOI"].alias("doi"), F.coalesce(_first(x["title"]), F.lit("")).alias("item_title"), _first(x["author"])["family"].alias("item_author"), F.coalesce(_first(x["container-title"]), F.lit("")).alias("item_journal"),
        F.coalesce(_year(x["published-print"]), _year(x["published-online"])).alias("item_year"), F.coalesce(x["score"], F.lit(0.0)).alias("base")))


def datacite(rows: DataFrame, *keep: str, column: str = "json") -> DataFrame:
    """The same of the registry of data sets, whose publishers stand for journals."""
    return _works(rows, keep, "datacite", F.from_json(column, DATACITE)["data"], lambda x: (
        x["id"].alias("doi"), F.coalesce(_first(x["attributes"]["titles"])["title"], F.lit("")).alias("item_title"), _first(x["attributes"]["creators"])["familyName"].alias("item_author"), F.coalesce(x["attributes"]["publisher"], F.lit("")).alias("item_journal"),
        F.nullif(x["attributes"]["publicationYear"], F.lit(0)).alias("item_year"), F.lit(DATACITE_BASE).alias("base")))


def people(rows: DataFrame, *keep: str, orcid: str = "orcid", status: str = "status", column: str = "json") -> DataFrame:
    """Kept columns, orcid as digits, name, affiliation, email (the primary one, else the first; empty if none), error."""
    j, bare = F.from_json(column, PERSON), bare_orcid(orcid)
    none = F.lit("")
    # named parts first: a missing one is empty, not null
    name = strip(F.concat_ws(" ", F.coalesce(j["name"]["given-names"]["value"], none), F.coalesce(j["name"]["family-name"]["value"], none)))
    work = _first(_first(j["employments"]["affiliation-group"])["summaries"])["employment-summary"]["organization"]["name"]
    mails = j["emails"]["email"]
    mail = F.coalesce(_first(F.filter(mails, lambda e: e["primary"])), _first(mails))["email"]
    state = F.col(status)
    error = (
        F.when(~is_orcid(orcid), F.concat(F.lit("Invalid ORCID format: "), F.coalesce(orcid, none))).when(state == 404, F.concat(F.lit("ORCID not found: "), bare))
        .when(state.isNull() | (state < 200) | (state > 299), F.concat(F.lit("ORCID API error: "), F.coalesce(state.cast("string"), F.lit("no answer"))))
        .when(F.get_json_object(column, "$").isNull(), "ORCID API error: no JSON")
    )
    said = lambda c, to: F.when(error.isNull(), F.coalesce(c, none)).alias(to)
    return rows.select(*keep, bare.alias("orcid"), said(name, "name"), said(work, "affiliation"), said(mail, "email"), error.alias("error"))


def doi_checks(rows: DataFrame, *keep: str, doi: str = "doi", status: str = "status", column: str = "json") -> DataFrame:
    """Kept columns, doi, valid, unreachable, error, and of a valid one title, authors, year (0 if there is none), journal (else the publisher), type.

    A registry that does not know the DOI makes it invalid; one that does not
    answer, or not in JSON, leaves it open.
    """
    j, state, own = F.from_json(column, WORK), F.col(status), F.col(doi)
    text = lambda name: F.nullif(F.coalesce(F.get_json_object(column, f"$['{name}'][0]"), F.get_json_object(column, f"$['{name}']")), F.lit("[]"))
    answered = state.between(200, 299) & F.get_json_object(column, "$").isNotNull()
    bad, gone = ~is_doi(doi), state.isin(404, 410)
    valid = ~bad & F.coalesce(answered, F.lit(False))
    open_ = ~bad & ~valid & ~F.coalesce(gone, F.lit(False))
    error = F.when(bad, "Invalid DOI format").when(gone, "DOI not found").when(state.isNull(), "no answer").when(~state.between(200, 299), F.concat(F.lit("HTTP "), state)).when(~valid, "no JSON")
    part = lambda *names: F.coalesce(*(F.nullif(n, F.lit("")) for n in names), F.lit(""))
    names = F.filter(F.transform(j["author"], lambda a: strip(F.concat_ws(" ", part(a["given"], a["givenName"]), part(a["family"], a["familyName"])))), lambda n: n != "")
    said = lambda c, to: F.when(valid, c).alias(to)
    return rows.select(
        *keep, own.alias("doi"), valid.alias("valid"), open_.alias("unreachable"), error.alias("error"), said(F.coalesce(text("title"), F.lit("")), "title"), said(F.coalesce(names, F.array().cast("array<string>")), "authors"),
        said(F.coalesce(_year(j["issued"]), _year(j["published"]), _year(j["created"]), F.lit(0)), "year"), said(part(text("container-title"), j["publisher"]), "journal"), said(j["type"], "type"),
    )


def bibliography_checked(entries: DataFrame, checks: DataFrame) -> DataFrame:
    """Entries (key, type, doi, skip) by what their DOI says and what doi_checks of it found, with a message; one row for each entry.

    Each DOI is looked up once, whatever the number of entries that name it; one that was never asked for is unreachable.
    """
    found = checks.select(bare_doi("doi").alias("_doi"), "valid", "unreachable", "error").groupBy("_doi").agg(
        F.max("valid").alias("_valid"), F.min("unreachable").alias("_open"), F.min(F.when(~F.col("valid"), F.col("error"))).alias("_error"))
    own = doi_status(entries)
    both = own.join(found, (own.doi == found._doi) & (own.status == "valid"), "left")
    looked_up = F.when(F.col("_valid"), "valid").when(F.col("_open"), "unreachable").when(~F.col("_open"), "invalid").otherwise("unreachable")
    status = F.when(F.col("status") == "valid", looked_up).otherwise(F.col("status"))
    no_doi, has_none = F.col("status") == "skipped", F.coalesce("doi", F.lit("")) == ""
    message = (
        F.when(F.col("skip"), "Marked as no-doi").when(no_doi, F.concat("type", F.lit(" typically has no DOI")))
        .when(has_none & F.col("expects_doi"), "Expected DOI for article/proceedings").when(has_none, "No DOI field")
        .when(F.col("status") == "invalid", "Invalid DOI format").when(~F.coalesce("_valid", F.lit(False)), F.coalesce("_error", F.lit("no answer")))
    )
    # without a DOI that is expected: missing; without one that nobody expects: skipped
    status = F.when(has_none & ~F.coalesce(F.col("skip"), F.lit(False)) & ~no_doi & ~F.col("expects_doi"), "skipped").otherwise(status)
    return both.select("key", "type", "doi", status.alias("status"), message.alias("message"))
