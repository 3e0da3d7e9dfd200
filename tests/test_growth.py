"""Steps whose work or memory must not grow faster than their input, against plain forms of the same."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import batches, markdown, markup, protect
from marginalia.functions import text as X
from marginalia.operators import citations, figures, importing, merging, projects, style
from marginalia.plans import relations, word_queries
from marginalia.plans.word_queries import word_file
from marginalia.sources import docx

COLUMNS = "doc_id long, reviewer string, reviewer_ord int, seq long, type string, start int, end int, old_text string, new_text string"


def plan(df):
    return df._jdf.queryExecution().toString()


def overlap(a, b):
    if a["type"] == b["type"] == "insert" and a["start"] == b["start"]:
        return a["new_text"] != b["new_text"]
    a_end, b_end = (x["start"] if x["type"] == "insert" else x["end"] for x in (a, b))
    return a_end > b["start"] and b_end > a["start"] and not all(a[k] == b[k] for k in ("type", "old_text", "new_text"))


def greedy(rows):
    """Every change against all later ones."""
    rows = sorted(rows, key=lambda r: (r["start"], r["end"], r["reviewer_ord"], r["seq"]))
    taken, out, n = set(), {}, 0
    for i, one in enumerate(rows):
        if i in taken:
            continue
        own = [i, *(j for j in range(i + 1, len(rows)) if j not in taken and overlap(one, rows[j]))]
        taken.update(own)
        n += len(own) > 1
        out |= {rows[m]["seq"]: (f"c{n}" if len(own) > 1 else None, k) for k, m in enumerate(own)}
    return out


def made(seed, docs=40):
    r = random.Random(seed)
    rows = []
    for doc in [None, *range(docs)]:
        for _ in range(r.randint(0, 40)):
            kind, start = r.choice(["insert", "delete", "replace"]), r.randint(0, 60)
            end = start if kind == "insert" else start + r.randint(1, 9)
            who = r.randint(0, 2)
            rows.append((doc, f"R{who}", who, len(rows), kind, start, end, r.choice(["", "a", None]), r.choice(["x", "y", None])))
    return rows


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_conflicts_as_by_trying_all(spark, batch):
    rows = made(batch)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = merging.conflicts(spark.createDataFrame(rows, COLUMNS), "doc_id")
        # one call of Python to a document costs milliseconds, and its small results were read by one task
        assert "FlatMapGroupsInPandas" not in plan(found)
        got = found.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows)
    for doc in {r["doc_id"] for r in got}:
        own = [r.asDict() for r in got if r["doc_id"] == doc]
        assert {r["seq"]: (r["conflict"], r["place"]) for r in own} == greedy(own)


def test_equal_changes_are_not_all_compared():
    state = merging._Grouping()
    for k in range(20_000):
        state.taken(k, "replace", 5, 9, "a", "b")
        state.taken(k, "insert", 9, 9, "", "b")
    assert len(state.open) <= 2
    assert state.taken(0, "replace", 5, 9, "a", "c")[1] == 1


def test_choices(spark):
    rows = made(5)
    found = merging.conflicts(spark.createDataFrame(rows, COLUMNS), "doc_id")
    own = {}
    for r in found.filter("conflict IS NOT NULL").collect():
        own.setdefault((r["doc_id"], r["conflict"]), {})[r["place"]] = r
    asked = [(d, c, k % 4 - 1 if k % 5 else None) for k, (d, c) in enumerate(sorted(own, key=str))] + [(0, "c999", 0)]
    asked += asked[:3]
    choices = spark.createDataFrame(asked, "doc_id long, conflict string, choice int")
    resolved = merging.resolved(found, choices, "doc_id")
    # the conflicts are made once, not once for sizes and once for rows
    assert plan(resolved).split("Physical Plan")[1].count("MapInArrow") == 1
    want = []
    for d, c, k in asked:
        if (d, c) in own:
            row, n = own[d, c].get(k), len(own[d, c])
            want.append((d, c, k, row and row["seq"] and row["new_text"], row and row["reviewer"], None if k is not None and 0 <= k < n else f"no such choice, there are {n}"))
    got = [(r["doc_id"], r["conflict"], r["choice"], r["new_text"] if r["reviewer"] else None, r["reviewer"], r["error"]) for r in resolved.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    left = merging.unresolved(found, choices, "doc_id").collect()
    good = {(d, c) for d, c, *_, error in want if error is None}
    assert sorted(((r["doc_id"], r["conflict"]) for r in left), key=str) == sorted(set(own) - good, key=str)


def test_each_image_goes_once(spark):
    rows = [(k, o, f"Cap {o % 2}", f"p{o % 3}.png", f"l{o}" if o else None) for k in range(30) for o in range(4)]
    images = spark.createDataFrame(rows, "doc_id long, ord int, caption string, path string, label string")
    got = figures.matched(images, images, "doc_id")
    assert "FlatMapGroupsInPandas" not in plan(got)
    rows = got.orderBy("doc_id", "f").collect()
    assert [(r["f"], r["o"]) for r in rows if r["doc_id"] == 7] == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert got.groupBy("doc_id", "o").count().filter(F.col("count") > 1).count() == 0


def test_copies_of_works_are_compared_once(spark):
    """The best work, its lead and its confidence are those of all pairs; copies make no pairs."""
    r = random.Random(3)
    titles = ["Rain on hills", "Rain over long passes", "Hills", None, "Snow, RAIN", "snow rain"]
    works = [(f"10.1/{k:04}{'.suppl' if k % 7 == 0 else ''}", r.choice(titles), r.choice(["Nature", "Sea and Sky", None]), r.choice(["Ann", "Bo"]), r.choice([2000, 2001, None])) for k in range(300)]
    wanted = [(k, r.choice(titles), r.choice(["Nature", "Sea"]), r.choice(["Ann", "ann li", None]), r.choice([2000, None])) for k in range(40)]
    w = spark.createDataFrame(works, "doi string, item_title string, item_journal string, item_author string, item_year int")
    q = spark.createDataFrame(wanted, "query_key long, title string, journal string, author string, year int")
    columns = ["query_key", "doi", "score", "runner_up", "confidence"]
    # titles that share a word, one word list against the other
    shares = F.arrays_overlap(*[F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda x: F.length(x) > 3) for c in ("title", "item_title")])
    scored = q.crossJoin(w).filter(shares).withColumn("base", F.lit(0.0))
    scored = scored.withColumn("score", citations.match_score("title", "journal", "year", "author", "item_title", "item_journal", "item_year", "doi", "item_author", "base"))
    want = citations.best_matches(scored).select(*columns)
    got = citations.best_known(q, w).select(*columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    once = got._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in once.lower()


def nodes(node):
    """The nodes of a plan that has run."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan") or "QueryStage" in name:
        yield from nodes(node.executedPlan() if name.startswith("Adaptive") else node.plan())
        return
    yield node
    children = node.children().iterator()
    while children.hasNext():
        yield from nodes(children.next())


@pytest.mark.parametrize("top", [1, 3])
def test_works_are_scored_term_by_term(spark, top):
    """What all pairs give, without all pairs, also where works agree in part only."""
    r = random.Random(top)
    words = ["rain", "snow", "hills", "Rivers", "of", "lands"]
    long = " ".join(f"word{k}" for k in range(11))  # shares of twelfths, which sums round
    titles = [f"{a} {b}" for a in words for b in words] + [f"rain {long}", f"snow {long} hills", None]
    journals, people = ["Nature", "nature", "Sea and Sky", "Sky Studies", None], ["Ann", "ANN", "Bo", "Ann Bo", "", None]
    works = [(f"10.1/{k // 2:04}{'.suppl' if k % 9 == 0 else ''}", r.choice(titles), r.choice(journals), r.choice(people), r.choice([2000, 2001, 2005, None])) for k in range(900)]
    wanted = [(k, r.choice(titles), r.choice(journals), r.choice(people), r.choice([2000, 2002, None])) for k in range(200)]
    w = spark.createDataFrame(works, "doi string, item_title string, item_journal string, item_author string, item_year int").cache()
    q = spark.createDataFrame(wanted, "query_key long, title string, journal string, author string, year int").cache()
    columns = ["query_key", "doi", "score", "rank", "runner_up", "confidence"]
    pairs = citations.candidates(q, w).withColumn("base", F.lit(0.0))
    scored = pairs.withColumn("score", citations.match_score("title", "journal", "year", "author", "item_title", "item_journal", "item_year", "doi", "item_author", "base"))
    want = citations.best_matches(scored, top=top).select(*columns).collect()
    got = citations.best_known(q, w, top).select(*columns)
    assert sorted(got.collect(), key=str) == sorted(want, key=str)
    made = [n.metrics().get("numOutputRows").get().value() for n in nodes(got._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
    assert made and max(made) * 3 < pairs.count() * top  # a few for each that is shown


def test_a_file_is_parsed_once(monkeypatch):
    data, calls, parse = word_file(0, "some text\nmore"), [], docx.ET.fromstring
    monkeypatch.setattr(docx.ET, "fromstring", lambda text: calls.append(1) or parse(text))
    assert docx.parts_of(data)["comments"][0]["anchor"] == "fellx0"
    assert len(calls) == 2  # the text and the comments
    assert docx.parts_of(b"none") == {"error": "not a Word document"}


def test_parts_are_those_that_an_import_takes():
    """The text of a file is not read and written twice, with and without its changes."""
    changed, flat = (docx.parts_of(word_file(k, "some text\nmore")) for k in (4, 2))
    assert changed["tracked"].startswith("some text\n\nmore\n\nRain {++heavily ++}") and not {"plain", "tables"} & set(changed)
    assert flat["plain"].startswith("some text\n\nmore") and len(flat["tables"]) == 1 and not {"tracked", "comments"} & set(flat)


def test_an_import_looks_through_its_texts_once(spark, tmp_path):
    """Long lines are not searched from each of their characters on; originals meet files in one join."""
    rows = [(k, "word " * (40_000 if k < 4 else k) + ("\nlast " if k % 2 else "")) for k in range(12)] + [(13, None), (14, None), (16, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = word_queries.QUERIES["word_import"](spark, str(tmp_path))
    whole = plan(got).split("Physical Plan")[1]
    assert r"[^\n]*\z" not in whole and whole.count("SortMergeJoin") + whole.count("BroadcastHashJoin") == 1
    rows = {int(r["path"][3:-5]): r for r in got.collect()}
    assert len(rows) == 15
    for k, r in rows.items():
        tail = (f"Rain {{++heavily ++}}fellx{k}{{>>Ann: look<<}} {{--on--}} here", "Rain fell on {~~the~>a~~} long pass today.", f"End {k}.", None)[k % 4]
        assert (r["tail"], r["way"]) == (tail, ("tracked", "compared", "plain", "failed")[k % 4])


@pytest.mark.parametrize("registry", [False, True])
def test_imports_without_and_with_originals(spark, registry):
    """A file without an original, or whose original has no text, is plain text; each original of a file gives a row."""
    files = spark.createDataFrame([(f"d{k}", word_file(k, f"See Figure {k} here.")) for k in (1, 5, 9, 13, 17, 2, 4, 7)], "path string, content binary")
    same = "See Figure {} here.\n\nRain fell on a long pass today."
    originals = spark.createDataFrame([("d1", same.format(1)), ("d5", None), ("d9", ""), ("d13", same.format(13)), ("d13", None), ("d4", "x"), ("d99", "y")], "path string, text string")
    entries = spark.createDataFrame([("d1", "fig", 1, "rain", "Cap", "p.png"), ("d17", "fig", 17, "snow", "Cap", "p.png")], "path string, kind string, num int, label string, caption string, picture string") if registry else None
    plain = [(f"d{k}", "plain", f"See Figure {k} here.\n\nRain fell on a long pass today.") for k in (5, 13, 17)]
    got = [(r["path"], r["way"], r["text"]) for r in importing.imported(files, originals, entries).collect()]
    if registry:
        plain[2] = ("d17", "plain", "See @fig:snow here.\n\nRain fell on a long pass today.")
    assert sorted(x for x in got if x[1] == "plain" and x[0] != "d2") == sorted(plain)
    compared = {x[0]: x[2] for x in got if x[1] == "compared"}
    assert sorted(compared) == ["d1", "d13", "d9"] and len(got) == 9
    assert compared["d13"] == same.format(13) and compared["d9"] == "{++See Figure 9 here.++}\n\n{++Rain fell on a long pass today.++}"
    assert ("{++" in compared["d1"] or "{~~" in compared["d1"]) == registry
    none = {r["path"]: r["way"] for r in importing.imported(files).collect()}
    assert none == {f"d{k}": "plain" for k in (1, 5, 9, 13, 17, 2)} | {"d4": "tracked", "d7": "failed"}


BITS = ["{--", "--}", "{++", "++}", "{~~", "~>", "~~}", "{>>", "<<}", "{==", "{", "[", "]", "[@kim2020]", "[@", "@fig:a", "$x$", "$", "(Kim 2020)", "; Kim 2021", "2020a).", "|", "| a |", "![", "{#t}", "- ", "# ", "1. ", "> ", "`", "**", "_", "---", ":"]
BITS += ["Fig. 2", "figure  S3", "TABLE 1", "tbl 4:", "ſ", "K", "\U0001f600", "wörd", "a", "b ", " ", "  ", "\n", "\n\n\n", "\t", ".", " ,", ""]


def test_marks_are_looked_for_first(spark, monkeypatch):
    """Texts without what a search needs are not searched; the results are those of the searches alone."""
    r = random.Random(8)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(0, 16))) for _ in range(4000)] + [None, "", "plain words only"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").repartition(4).cache()
    now = [markdown.tidy("x"), protect.citations_kept("x"), F.get(F.split("x", markup.MARKER, 2), F.lit(0))]
    now += [F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (protect.WHOLE, importing.PLAIN)]
    now.append(F.when(F.col("x").rlike(markdown.SOME_MARK), markdown.plain("x")).otherwise(X.strip("x")))
    monkeypatch.setattr(markdown, "chain_marked", X.chain)
    monkeypatch.setattr(protect, "chain_marked", X.chain)
    want = [markdown.tidy("x"), protect.citations_kept("x"), F.regexp_extract("x", rf"(?s)\A.*?(?={markup.MARKER}|\z)", 0)]
    want += [F.regexp_extract_all("x", F.lit(p), F.lit(0)) for p in (protect.TABLE + "|" + protect.PROTECTED, importing.PLAIN.replace("(?=[ft])", ""))]
    want.append(markdown.plain("x"))
    for a, b in zip(now, want, strict=True):
        assert df.select("x", a.alias("a"), b.alias("b")).filter("NOT a <=> b").collect() == []
    known = protect.pieces("x", pattern=protect.WHOLE)
    back = protect.shown(protect.hidden("x", known, protect.fence("x"), protect.WHOLE), known, protect.fence("x"))
    assert df.select("x", back.alias("b")).filter("NOT x <=> b").collect() == []


def test_batches_of_texts_are_small(spark):
    """A worker holds some hundred texts or files, not ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for ask, most in ((10_000, batches.ROWS), (0, batches.ROWS), (7, 7)):
            spark.conf.set(name, ask)
            files = spark.createDataFrame([(f"d{k}.docx", word_file(2, "x")) for k in range(3)], "path string, content binary")
            assert docx.read(files, "headings").count() == 3
            assert int(spark.conf.get(name)) == most
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("most", [0, 200_000])
def test_words_do_not_move_to_a_small_dictionary(spark, monkeypatch, most):
    monkeypatch.setattr(style, "FEW_WORDS", most)
    found = spark.createDataFrame([(1, 2, 0, "Rain"), (1, 1, 3, "rain"), (1, 1, 4, "Snow"), (2, 1, 0, "snow"), (2, 1, 1, "the"), (2, 1, 2, "Hill")], "doc_id long, line int, place int, word string")
    known = spark.createDataFrame([("the",), ("snow",), ("snow",)], "word string")
    got = style.unknown(found, known, "doc_id")
    assert sorted((r["doc_id"], r["line"], r["word"], r["is_name"]) for r in got.collect()) == [(1, 1, "rain", False), (2, 1, "Hill", True)]
    assert ("LeftAnti, BuildRight" in plan(got)) or most == 0


@pytest.mark.parametrize("name", ["conflicts_resolved", "conflicts_unresolved"])
def test_conflicts_are_made_once(spark, data, name):
    """What asks for conflicts and what is asked of them read the same table."""
    assert "MapInArrow" not in plan(relations.QUERIES[name](spark, data))


def test_statistics_count_conflicts_by_their_first_change(spark):
    found = merging.conflicts(spark.createDataFrame(made(11), COLUMNS), "doc_id")
    got = merging.statistics(found, "doc_id")
    # with one thing counted by its different values rows are not doubled for each
    assert "Expand" not in plan(got)
    want = found.groupBy("doc_id").agg(F.count_distinct("reviewer"), F.count("*"), F.count_if(F.col("conflict").isNull()), F.count_distinct("conflict"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def shown(text, start, end):
    """Around and of a place, as SQL's substr has it where places are not before the text."""
    before, after = text[max(start - 50, 0) : start].strip(), text[end : end + 50].strip()
    rows = [f"  ...{before}"] if before else []
    rows.append(f'  [ORIGINAL]: "{text[start:end] or "(insertion point)"}"')
    return "\n".join([*rows, *([f"  {after}..."] if after else []), "", "  Options:"])


@pytest.mark.parametrize("piece", [1, 7, 256])
def test_conflicts_read_pieces_of_their_text(spark, monkeypatch, piece):
    monkeypatch.setattr(figures, "PIECE", piece)
    text = "".join(f"wärd {k}\U0001f600\n" for k in range(120))
    places = [(0, 0), (0, 9), (3, 3), (49, 60), (250, 262), (300, 300), (255, 256), (256, 900), (len(text) - 1, len(text)), (len(text), len(text) + 9), (5000, 5001), (90, 40)]
    places += [(-5, 3), (-60, -50), (None, 4), (None, None)]
    rows = [(d, f"c{k}", p, f"R{p}", "replace", a, b, "old", "new" * 30) for d in (1, 2, 3) for k, (a, b) in enumerate(places) for p in (0, 1)]
    found = spark.createDataFrame(rows, "doc_id long, conflict string, place int, reviewer string, type string, start int, end int, old_text string, new_text string")
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["conflict"]): r["shown"] for r in figures.conflict_text(found, texts, "doc_id").collect()}
    assert len(got) == 3 * len(places)
    for d, own in ((1, text), (2, "")):
        for k, (a, b) in enumerate(places):
            if a is not None and a >= 0:
                assert got[d, f"c{k}"].startswith(shown(own, a, b) + "\n    1. [R0]"), (d, a, b)
    # places before the text count from its end; what has no place shows how the text begins
    assert f'[ORIGINAL]: "{text[-4:]}"' in got[1, "c12"]
    assert got[1, "c15"].startswith(f"  ...{text[:50].strip()}\n\n  Options:") and "ORIGINAL" not in got[3, "c1"]


def test_known_forms_go_before_words_are_moved(spark):
    found = spark.createDataFrame([(1, 2, 0, "Cat"), (1, 1, 3, "cats"), (1, 1, 4, "Dog"), (2, 1, 0, "dog"), (2, 1, 1, "uncat"), (2, 2, 2, "dog")], "doc_id long, line int, place int, word string")
    stems = spark.createDataFrame([("cat", ["S"])], "word string, flags array<string>")
    rules = style.affix_rules(spark.createDataFrame([("SFX S Y 1\nSFX S 0 s .\nPFX U Y 1\nPFX U 0 un .",)], "text string"))
    got = style.unknown_by_affixes(found, stems, rules, "doc_id")
    assert sorted((r["doc_id"], r["line"], r["word"], r["is_name"]) for r in got.collect()) == [(1, 1, "Dog", True), (2, 1, "dog", False), (2, 1, "uncat", False)]
    assert "LeftAnti, BuildRight" in plan(got)
    whole = plan(got).split("Physical Plan")[1]
    assert whole.index("Window ") < whole.index("LeftAnti")  # first uses are looked for among what is left


def test_only_changed_words_are_moved(spark):
    rows = [(1, "a  b\tb\x0bc d ", " b c d a x x"), (1, "x", None), (2, "same words", "words\nsame"), (3, None, None), (4, " \n", ""), (None, "p q", "q"), (None, "", "p p"), (5, "", " ")]
    versions = spark.createDataFrame(rows, "doc_id long, old string, new string")
    got = projects.word_count_diff(versions, "doc_id", "old", "new")
    assert "explode" not in plan(got).split("Physical Plan")[1]

    def counted(c, sign):
        return versions.select("doc_id", F.explode(F.filter(F.split(c, r"\s+"), lambda w: w != "")).alias("w"), F.lit(sign).alias("s"))

    change = counted("old", -1).unionByName(counted("new", 1)).groupBy("doc_id", "w").agg(F.sum("s").alias("n"))
    want = change.groupBy("doc_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert projects._changed_words("same words", "words same") == [(None, 0)]
