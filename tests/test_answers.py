"""Registries' answers: what is missing, broken or odd in them."""

from marginalia.sources import answers


def rows(spark, *values):
    return spark.createDataFrame([(k, *v) if isinstance(v, tuple) else (k, v) for k, v in enumerate(values)], "id long, json string")


def test_works(spark):
    texts = (
        '{"message": {"items": [{"DOI": "10.1/a", "title": ["A", "B"], "author": [{"given": "X"}], "published-print": {"date-parts": [[]]}, "published-online": {"date-parts": [[2001]]}, "score": 3}, {}]}}',
        '{"message": {"items": []}}', '{"message": null}', "[]", "", None, '{"message": {"items": [',
    )
    got = [tuple(r) for r in answers.crossref(rows(spark, *texts), "id").orderBy("id", "n").collect()]
    assert got == [(0, "crossref", 0, "10.1/a", "A", None, "", 2001, 3.0), (0, "crossref", 1, None, "", None, "", None, 0.0)]
    texts = ('{"data": [{"id": "10.5/z", "attributes": {"titles": [], "creators": [{"familyName": "Lee"}, {"familyName": "Ray"}], "publicationYear": 2020}}]}', '{"data": {}}', "x")
    got = [tuple(r) for r in answers.datacite(rows(spark, *texts), "id").collect()]
    assert got == [(0, "datacite", 0, "10.5/z", "", "Lee", "", 2020, 50.0)]


def test_verdicts(spark):
    asked = spark.createDataFrame(
        [
            (1, "10.1234/a", 200, '{"title": "T", "container-title": [], "publisher": "P", "issued": {"date-parts": [[]]}, "published": {"date-parts": [[1999]]}, "author": [{"given": " A ", "family": "B"}, {}, {"givenName": "C"}]}'),
            (2, "10.1234/a", 404, None), (3, "10.1234/a", 410, "{}"), (4, "10.1234/a", 429, "{}"), (5, "10.1234/a", None, None), (6, "10.1234/a", 200, "no json"), (7, "a", 200, "{}"), (8, None, 200, "{}"), (9, "10.1234/b", 204, "{}"),
        ],
        "id int, doi string, status int, json string",
    )
    got = {r["id"]: r for r in answers.doi_checks(asked, "id").collect()}
    assert {k: (r["valid"], r["unreachable"], r["error"]) for k, r in got.items()} == {
        1: (True, False, None), 2: (False, False, "DOI not found"), 3: (False, False, "DOI not found"), 4: (False, True, "HTTP 429"), 5: (False, True, "no answer"),
        6: (False, True, "no JSON"), 7: (False, False, "Invalid DOI format"), 8: (False, False, "Invalid DOI format"), 9: (True, False, None),
    }
    assert tuple(got[1])[5:] == ("T", ["A  B", "C"], 1999, "P", None)
    assert tuple(got[9])[5:] == ("", [], 0, "", None) and tuple(got[2])[5:] == (None,) * 5


def test_people(spark):
    asked = spark.createDataFrame(
        [
            ("0000-0001-2345-678X", 200, '{"name": null, "emails": {"email": []}, "employments": {"affiliation-group": []}}'), ("0000-0001-2345-6789", None, None), ("0000-0001-2345-6780", 200, "cut {"),
            ("HTTP://orcid.org/0000-0001-2345-6781", 200, '{"name": {"given-names": {"value": "Ann"}}, "emails": {"email": [{"email": "a"}, {"email": "b", "primary": true}]}}'), (None, 200, "{}"),
        ],
        "orcid string, status int, json string",
    )
    got = [tuple(r) for r in answers.people(asked).collect()]
    assert got[0] == ("0000-0001-2345-678X", "", "", "", None)
    assert got[1][4] == "ORCID API error: no answer" and got[1][1] is None
    assert got[2][4] == "ORCID API error: no JSON"
    assert got[3] == ("0000-0001-2345-6781", "Ann", "", "b", None)
    assert got[4][4] == "Invalid ORCID format: "


def test_bibliography(spark):
    entries = spark.createDataFrame(
        [("a", "article", "https://doi.org/10.1234/x", False), ("b", "article", "10.1234/x", False), ("c", "article", None, False), ("d", "book", None, False), ("e", "online", None, False), ("f", "article", "10.1234/y", True), ("g", "article", "zz", None), ("h", "article", "10.1234/none", False)],
        "key string, type string, doi string, skip boolean",
    )
    checks = answers.doi_checks(spark.createDataFrame([("10.1234/x", 500, None), ("10.1234/x", 200, "{}"), ("10.1234/y", 404, None)], "doi string, status int, json string"))
    got = {r["key"]: (r["status"], r["message"]) for r in answers.bibliography_checked(entries, checks).collect()}
    assert got == {
        "a": ("valid", None), "b": ("valid", None), "c": ("missing", "Expected DOI for article/proceedings"), "d": ("skipped", "book typically has no DOI"), "e": ("skipped", "No DOI field"),
        "f": ("skipped", "Marked as no-doi"), "g": ("invalid", "Invalid DOI format"), "h": ("unreachable", "no answer"),
    }
