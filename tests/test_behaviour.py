"""Examples of what the operators must give."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import diff, markdown, markup, protect
from marginalia.functions import text as X
from marginalia.operators import anchors, annotations, citations, crossref, diffs, equations, figures, journals, lines, merging, paragraphs, sections, style, threads


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("v")).first()["v"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize(
    "text, rows",
    [
        ("Rain {++and wind++} came.", [("insert", "and wind", None, None, 1)]),
        ("Rain {~~fell~>poured~~} down.", [("substitute", "fell", "poured", None, 1)]),
        ("Rain {>>Bo: how much of it?<<} fell.", [("comment", "how much of it?", None, "Bo", 1)]),
        ("Rain {>>nobody said so<<} fell.", [("comment", "nobody said so", None, "", 1)]),
        ("first row\n{++put in++}\nlast row", [("insert", "put in", None, None, 2)]),
        ("{>>Figure 12. Daily rain at the three stations of the valley.<<}", []),
        ("`{>>Ann: code<<}`", []),
        ("{--gone {>>Ann: inside<<} too--}", [("delete", "gone {>>Ann: inside<<} too", None, None, 1)]),
        ("no markup", []),
    ],
)
def test_annotations(spark, text, rows):
    got = annotations.annotations(docs(spark, text), "doc_id").orderBy("pos", "kind_rank").collect()
    assert [(r["kind"], r["content"], r["replacement"], r["author"], r["line"]) for r in got] == rows


def test_many_annotations(spark):
    text = " ".join(f"{{++word{k}++}}" for k in range(100))
    assert annotations.annotations(docs(spark, text), "doc_id").count() == 100


@pytest.mark.parametrize(
    "text, out",
    [
        ("{--{--{--## Old head--}--}--}", ""),
        ("{++{++twice put in++}++}", "twice put in"),
        ("{--{++came and went++}--}", ""),
        ("k {++one++}l{--two--}m{~~three~>four~~}n{>>Q: so?<<}o[five]{.mark}p", "k onelmfournofivep"),
        ("left {>>Q: is 3 < 4 > 2 in <b>bold</b>?<<} right", "left  right"),
    ],
)
def test_strip(spark, text, out):
    got = one(spark, markup.stripped("t"), t=text)
    assert got == out
    assert one(spark, markup.stripped("t"), t=got) == got


def test_strip_keeps_comments(spark):
    assert one(spark, markup.stripped("t", keep_comments=True), t="{--{--went--}--} {>>Bo: stays here<<}") == " {>>Bo: stays here<<}"
    got = one(spark, markup.stripped("t"), t="{~~{~~east~>north~~}~>west~~}")
    assert not any(m in got for m in ("{~~", "~~}", "~>"))


@pytest.mark.parametrize(
    "text, keys",
    [
        ("[@Lund1987; @Okoro2003]", {"Lund1987", "Okoro2003"}),
        ("As @Lund1987 measured, rain came late.", {"Lund1987"}),
        ("Nobody is cited in [Lund1987] here.", set()),
        ("[@O-Hara-Lee1999], later [@Lund_Okoro2004]", {"O-Hara-Lee1999", "Lund_Okoro2004"}),
        ("[@Lund1987a; @Lund1987b]", {"Lund1987a", "Lund1987b", "Lund1987"}),
        ("```\n", set()),
        ("<!-- [@Secret1901] -->", set()),
    ],
)
def test_citations(spark, text, keys):
    assert {r["key"] for r in citations.citations(docs(spark, text), "doc_id").collect()} == keys


@pytest.mark.parametrize(
    "written, out",
    [
        ("1-3", ["1", "2", "3"]),
        ("1, 2, and 3", ["1", "2", "3"]),
        ("1a-c", ["1a", "1b", "1c"]),
        ("1a, b, c", ["1a", "1b", "1c"]),
        ("S1-S3", ["S1", "S2", "S3"]),
        ("1a-2b", ["1a", "1b", "2a", "2b"]),
        ("1 & 4", ["1", "4"]),
        ("3-1", []),
    ],
)
def test_number_lists(spark, written, out):
    got = one(spark, crossref.numbers("w"), w=written)
    assert [("S" if n["is_supp"] else "") + str(n["num"]) + (n["suffix"] or "") for n in got] == out


def test_written_references(spark):
    got = crossref.written_references(docs(spark, "Compare Figs. 4-6 with Table 3, then Figures 7 and 9."), "doc_id").orderBy("pos").collect()
    assert [(r["kind"], r["list"]) for r in got] == [("fig", "4-6"), ("tbl", "3"), ("fig", "7 and 9")]


def test_forward_references(spark):
    before, after, none = "First @fig:rain is named.\n\n![Rain](r.png){#fig:rain}", "![Rain](r.png){#fig:rain}\n\nThen @fig:rain is named.", "Only @fig:snow is named."
    got = {(r["doc_id"], r["label"]) for r in crossref.forward(docs(spark, before, after, none), "doc_id").collect()}
    assert got == {(0, "rain"), (2, "snow")}
    assert crossref.anchors(docs(spark, after), "doc_id").first()["pos"] == 14


def test_equations(spark):
    got = equations.equations(docs(spark, "Both $a$ and $b$ stand before $$c$$", "It costs \\$5 or $x$", "$$\na\nb\n$$ then $z$"), "doc_id").collect()
    rows = {(r["doc_id"], r["kind"], r["content"], r["line"]) for r in got}
    assert rows == {(0, "inline", "a", 1), (0, "inline", "b", 1), (0, "display", "c", 1), (1, "inline", "x", 1), (2, "display", "a\nb", 1), (2, "inline", "z", 4)}


@pytest.mark.parametrize("text, rule", [("Gauges were emptied at noon.", "passive-voice"), ("Rain on on the hill.", "duplicate-words"), ("Our gauge proves nothing.", "prove"), ("rain was significant there", "significant")])
def test_style(spark, text, rule):
    assert rule in {r["rule"] for r in style.issues(docs(spark, text), "doc_id").collect()}


def test_style_exceptions(spark):
    assert "significant" not in {r["rule"] for r in style.issues(docs(spark, "a significant problem"), "doc_id").collect()}
    assert "prove" not in {r["rule"] for r in style.issues(docs(spark, "The gauge proves nothing."), "doc_id", scientific=False).collect()}
    words = spark.createDataFrame([("very",)], "word string")
    assert style.issues(docs(spark, "Rain fell.\nIt was very wet."), "doc_id", dictionary=words).count() == 0


def test_suggestions_for_all_unknown_words(spark, data):
    """Every unknown word of documents gets the words that brute force gives."""
    from marginalia.plans import catalogue, documents

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    known = spark.createDataFrame([(w,) for w in ("question", "station", "stations", "there", "three", "at", "cat")], "word string")
    d = docs(spark, "Where is the Staton\nand the qestion of there", "a thre cats", None, "")
    unknown = sorted(r["word"] for r in documents.unknown_words(d, known).collect())
    assert unknown == ["and", "cats", "qestion", "staton", "the", "thre", "where"]
    words = [r["word"] for r in known.collect()]
    want = {(u, w, distance(u, w)) for u in unknown for w in sorted((w for w in words if 1 <= distance(u, w) <= 2), key=lambda w: (distance(u, w), w))[:5]}
    got = style.suggestions(documents.unknown_words(d, known), known).select("wrong", "word", "distance")
    assert {tuple(r) for r in got.collect()} == want
    # the query looks words of documents up, not of the dictionary
    unknown = {r["word"].lower() for r in catalogue.queries()["spelling_unknown"](spark, data).collect()}
    wrong = {r["wrong"] for r in catalogue.queries()["spelling_suggest_documents"](spark, data).collect()}
    assert wrong and wrong <= unknown


def test_spelling_words(spark):
    got = {r["word"] for r in style.words(docs(spark, "The WMO and NOAA stations.\n```\nloop body\n```\nplain words", "---\ntitle: buried\n---\nvisible"), "doc_id").collect()}
    assert "stations" in got and "plain" in got and "visible" in got
    assert not {"NOAA", "loop", "buried"} & got


def test_suggestions(spark):
    wrong = spark.createDataFrame([("statoin",), ("wheather",)], "word string")
    known = spark.createDataFrame([("station",), ("weather",), ("umbrella",)], "word string")
    assert {(r["wrong"], r["word"]) for r in style.suggestions(wrong, known).collect()} == {("statoin", "station"), ("wheather", "weather")}


def test_threads(spark):
    got = threads.threads(docs(spark, "Rain {>>Bo: how much?<<} {>>Ida: two inches<<} fell.", "{>>Bo: when?<<} {>>Ida: in May<<} {>>Bo: thank you<<}"), "doc_id").orderBy("doc_id").collect()
    assert [len(r["replies"]) for r in got] == [1, 2]
    assert got[0]["context"] == "Rain   fell."


def test_roots_of_chains_and_circles(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "y"), ("y", "x")]
    got = {r["id"]: r["root"] for r in threads.roots(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert {got[k] for k in "abcd"} == {"a"}
    assert got["x"] in "xy" and got["y"] in "xy"


def changes(spark, *rows):
    return spark.createDataFrame([(0, *r) for r in rows], "doc_id long, reviewer string, reviewer_ord int, seq long, type string, start int, end int, old_text string, new_text string")


def test_conflicts(spark):
    both = changes(spark, ("R1", 1, 0, "replace", 0, 5, "rainy", "wet"), ("R2", 2, 0, "replace", 0, 5, "rainy", "damp"))
    assert merging.conflict_summary(merging.conflicts(both, "doc_id"), "doc_id").first()["changes"] == 2
    same = changes(spark, ("R1", 1, 0, "replace", 0, 5, "rainy", "wet"), ("R2", 2, 0, "replace", 0, 5, "rainy", "wet"))
    found = merging.conflicts(same, "doc_id")
    assert found.filter("conflict IS NOT NULL").count() == 0
    assert merging.deduplicated(found, "doc_id").count() == 1
    apart = changes(spark, ("R1", 1, 0, "replace", 0, 5, "a", "b"), ("R2", 2, 0, "replace", 10, 15, "c", "d"))
    assert merging.conflicts(apart, "doc_id").filter("conflict IS NOT NULL").count() == 0
    inserts = changes(spark, ("R1", 1, 0, "insert", 5, 5, "", " heavy"), ("R2", 2, 0, "insert", 5, 5, "", " light"))
    assert merging.conflicts(inserts, "doc_id").filter("conflict IS NOT NULL").count() == 2


def test_diff():
    assert diff.changes("Rain fell", "Rain poured") == [{"type": "replace", "start": 5, "end": 9, "old_text": "fell", "new_text": "poured"}]
    assert diff.changes("Some heavy rain fell", "Some light rain fell")[0]["start"] == 5
    assert diff.changes("", "") == [] and diff.changes("a", "a") == []


def test_shortest_scripts():
    """Scripts rebuild both sides and are as short as the longest common subsequence allows."""
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        script = diff.edits(a, b)
        assert sum(i2 - i for kind, i, i2, _, _ in script if kind == "equal") == best[-1][-1]
        assert [t for kind, i, i2, _, _ in script if kind != "insert" for t in a[i:i2]] == a
        assert [t for kind, _, _, j, j2 in script if kind != "delete" for t in b[j:j2]] == b


def smart(spark, old, new, **kw):
    return paragraphs.smart(spark.createDataFrame([(1, old, new)], "id int, old string, new string"), "id", **kw).first()["text"]


@pytest.mark.parametrize(
    "old, new, text",
    [
        ("Take $r-s$ of it.", "Take $r-t$ of it.", "Take {~~$r-s$~>$r-t$~~} of it."),
        ("Rain fell.\n\nSnow lay on the pass.", "Rain fell.\n\nSnow lay on a pass.", "Rain fell.\n\nSnow lay on {~~the~>a~~} pass."),
        ("# Snow\n\ngone", "other words", "# Snow\n\n{--gone--}\n\n{++other words++}"),
        ("see \U000f0000 here [@Lund1987] and qqqq1x", "see \U000f0000 here [@Lund1987] or qqqq1x", "see \U000f0000 here [@Lund1987] {~~and~>or~~} qqqq1x"),
        ("a[@A1]b [@A1]", "a[@A1]b", "a[@A1]b{-- [@A1]--}"),
        (None, "came", "{++came++}"),
        ("went", None, "{--went--}"),
        (None, None, ""),
    ],
)
def test_smart_diff(spark, old, new, text):
    assert smart(spark, old, new) == text


def test_smart_diff_of_what_a_word_processor_shows(spark):
    old = "## Rain\n\nIt **rained** $x_1$ mm [@Lund1987] in May.\n\n- one more point"
    got = smart(spark, old, "Rain\n\nIt rained x_1 mm (Lund 1987) in June.\n\none more point", shown=True)
    assert got == "## Rain\n\nIt rained $x_1$ mm [@Lund1987] in {~~May~>June~~}.\n\n- one more point"


def test_many_protected_pieces(spark):
    old, new = (" ".join(f"${x}{k}$ is" for k in range(3000)) + end for x, end in (("a", " so."), ("a", " not.")))
    assert smart(spark, old, new) == old[:-4] + " {~~so~>not~~}."


def test_alignment():
    left = ["first line of words", "- a mark of its own", "nothing like it", "last words here", ""]
    right = ["put in before all", "first line of other words", "a mark of its", "last words there", "last words here"]
    assert [x[:2] for x in diff.alignment(left, right)] == [(0, 1), (1, 2), (2, None), (3, 4), (4, None)]
    assert diff.alignment(left, right)[0][2] == 4 / 5
    assert diff.alignment(["- begins like the next"], ["x begins like the next one of many others that go on and on and on"])[0] == (0, 0, 0.0)
    assert diff.alignment([], ["x"]) == [] and diff.alignment(["x"], []) == [(0, None, None)]


def test_word_tables(spark):
    text = "Before.\n\nSite Rain\nHill 12\n\nBehind."
    table = "| Site | Rain |\n|---|---|\n| Hill | 12 |"
    texts = spark.createDataFrame([(1, text), (2, "no such cells"), (None, "Site 12"), (4, None), (2**53 + 1, "Site 12 end")], "k long, text string")
    tables = spark.createDataFrame([(1, 0, table), (2, 0, table), (None, 0, table), (4, 0, table), (2**53 + 1, 0, None), (2**53 + 1, 1, "no cells"), (2**53 + 1, 2, "||")], "k long, ord int, markdown string")
    got = {r["k"]: r["text"] for r in paragraphs.tables_set_in(texts, tables, "k").collect()}
    assert got == {1: f"Before.\n\n{table}\n\n\n\nBehind.", 2: "no such cells", None: f"{table}\n\n", 4: None, 2**53 + 1: "Site 12 end"}


@pytest.mark.parametrize(
    "text, kept",
    [
        ("a {--$x$--} b", "a $x$ b"),
        ("a {~~[@A2020]~>(Author 2020)~~} b", "a [@A2020] b"),
        ("a {~~[@A2020] old~>new~~} b", "a [@A2020] {~~old~>new~~} b"),
        ("a{++(Author et al. 2021; Other 2022)++}.", "a."),
        ("a{++ ++} .", "a."),
        ("a {++real words++} b", "a {++real words++} b"),
        ("x {~~[@~>(~~}Smith2020] y", "x [@Smith2020] y"),
    ],
)
def test_citations_kept(spark, text, kept):
    assert one(spark, protect.citations_kept("t"), t=text) == kept


def test_placement_keeps_keys(spark):
    """Large keys beside nulls; the comments of a null key meet its text."""
    keys = [2**53 + 1, None, 2**53 + 3, 7]
    texts = spark.createDataFrame([(k, "rain fell here") for k in keys], "k long, text string").coalesce(1)
    names = "k long, ord int, id string, author string, text string, anchor string, before string, after string, position double, parent string"
    rows = spark.createDataFrame([(k, 1, "1", "A", f"of {k}", "rain", "", "", 0.0, None) for k in keys[:3]], names)
    got = {r["k"]: r["text"] for r in diffs.placed(texts, rows, "k").collect()}
    assert got == {k: f"rain{{>>A: of {k}<<}} fell here" for k in keys[:3]} | {7: "rain fell here"}


def test_single_space():
    assert diff.single_spaced("a  b   c") == "a b c"
    assert diff.single_spaced("aa  bb\ncc  dd") == "aa  bb\ncc  dd"


def test_placement():
    text, report = diff.placed("a long cold rain began. a rain ended.", [{"id": "1", "author": "A", "text": "x", "anchor": "rain", "before": "a", "after": "ended", "position": 0.8}, {"id": "2", "author": "B", "text": "y", "parent": "1"}])
    assert text == "a long cold rain began. a rain{>>A: x<<}{>>↪ B: y<<} ended."
    assert [r["strategy"] for r in report] == ["direct", "reply"]


SNOW = "The gauge by the {++lower ++}bridge froze twice last winter, so its readings were left out."
BARE = SNOW.replace("{++", "").replace("++}", "")


@pytest.mark.parametrize(
    "anchor, before, after, name, positions",
    [
        ("BY THE", "", "", "direct", [SNOW.index("by the")]),
        ("froze   twice\nlast", "", "", "normalized", [SNOW.index("froze")]),
        ("the lower bridge", "", "", "stripped", [BARE.index("the lower")]),
        ("froze twice last winter and thawed", "", "", "partial-start", [SNOW.index("froze")]),
        ("it froze twice last winter", "", "", "partial-window", [SNOW.index("froze")]),
        ("by the lower bridge and weir", "", "", "partial-start-stripped", [BARE.index("by the")]),
        ("close by the lower bridge", "", "", "partial-window-stripped", [BARE.index("by the")]),
        ("a thaw in spring", "last winter,", "were left out.", "context-both", [SNOW.index(" so its")]),
        ("a thaw in the early spring of that year, which nobody in the valley saw", "froze twice ", "last winter", "failed", []),
        ("a thaw", "last winter,", "", "context-before", [SNOW.index(" so its")]),
        ("a thaw", "", "readings", "context-after", [SNOW.index("readings")]),
        ("thaw, readings", "", "", "split-match", [SNOW.index("readings")]),
        ("a thaw", "", "", "failed", []),
        ("", "last winter,", "", "context-before", [SNOW.index(" so its")]),
        ("  ", "", "", "empty-anchor", []),
        (None, None, None, "empty-anchor", []),
    ],
)
def test_anchors(spark, anchor, before, after, name, positions):
    got = one(spark, anchors.found("a", "t", "b", "f"), a=anchor, t=SNOW, b=before, f=after)
    assert (got["strategy"], got["positions"]) == (name, positions)


def test_anchors_of_many_documents(spark):
    """Comments of one text, of a text without comments, of a missing text; null keys meet; extra columns stay."""
    texts = spark.createDataFrame([(1, SNOW), (2, "x"), (None, "lost rain"), (4, None)], "id long, text string")
    rows = [(1, "froze", "", "", "a"), (1, "weir", "", "", "b"), (None, "rain", "", "", "c"), (4, "rain", None, None, "d"), (9, "rain", "", "", "e")]
    got = anchors.located(spark.createDataFrame(rows, "id long, anchor string, before string, after string, author string"), texts, "id").collect()
    assert sorted((r["author"], r["strategy"], r["positions"]) for r in got) == [("a", "direct", [SNOW.index("froze")]), ("b", "failed", []), ("c", "direct", [5]), ("d", "failed", [])]


def test_offsets_of_many_matches(spark):
    """Running lengths over more matches than a chunk of sums."""
    text = "".join(f"{{++a{k}++}} é " for k in range(700))
    got = one(spark, markup.matches("t", markup.INSERT, 1), t=text)
    assert [(r["pos"], r["g1"]) for r in got] == [(m.start(), m[1]) for m in re.finditer(r"\{\+\+(.+?)\+\+\}", text)]
    assert one(spark, anchors.occurrences("t", "n"), t=text, n="} ") == [m.start() for m in re.finditer("} ", text)]


def test_occurrences(spark):
    assert one(spark, anchors.occurrences("t", "n"), t="aaaa", n="aa") == [0, 1, 2]
    assert one(spark, anchors.occurrences("t", "n"), t="aaaa", n="") == []


def test_headings(spark):
    config = spark.createDataFrame([("introduction.md", "Introduction", ["Intro"], 1), ("methods.md", "Materials and Methods", [], 2), ("results.md", "Results", [], 3)], "file string, header string, aliases array<string>, ord int")
    titles = spark.createDataFrame([("Intro",), ("INTRODUCTION",), ("Materials and Methods section",), ("Weather of the Valley",)], "title string")
    got = {r["title"]: r["file"] for r in sections.matched(titles, config).collect()}
    assert got == {"Intro": "introduction.md", "INTRODUCTION": "introduction.md", "Materials and Methods section": "methods.md", "Weather of the Valley": None}


def test_affixes(spark):
    """Suffixes, prefixes and both, with strips, conditions and flags; what no rule makes stays unknown."""
    from marginalia.plans.documents import AFFIX_FILE

    rules = style.affix_rules(spark.createDataFrame([(AFFIX_FILE,)], "text string"))
    assert rules.count() == 7
    stems = spark.createDataFrame([("city", ["S"]), ("Bake", ["G", "U"]), ("rock", ["S", "N", "U"]), ("fox", ["S"]), ("bake", ["S"]), ("plain", None)], "word string, flags array<string>")
    asked = {"cities": "city", "citys": None, "Baking": "bake", "bakeing": None, "unbaking": "bake", "unrocks": "rock", "rocken": "rock", "unrocken": None, "unrock": "rock", "foxes": "fox", "foxs": None, "unfox": None, "plain": "plain", "plains": None, "bakes": "bake", "unbakes": "bake", "s": None, "un": None}
    got = {r["word"]: r["stem"] for r in style.known_by_affixes(spark.createDataFrame([(w,) for w in asked], "word string"), stems, rules).collect()}
    assert got == {w.lower(): stem for w, stem in asked.items() if stem}


def test_headings_with_repeated_configuration(spark):
    """Equal rows of the configuration don't add up to a match."""
    rows = [("m.md", "Materials and Methods", [], 2)] * 3
    config = spark.createDataFrame(rows, "file string, header string, aliases array<string>, ord int")
    titles = spark.createDataFrame([("Methods",), ("Materials and Methods",)], "title string")
    assert {r["title"]: r["file"] for r in sections.matched(titles, config).collect()} == {"Methods": None, "Materials and Methods": "m.md"}


@pytest.mark.parametrize("doi, ok", [("10.5555/rain.1987", True), ("10.55/rain.1987", False), ("12.5555/rain.1987", False), ("", False)])
def test_doi(spark, doi, ok):
    assert one(spark, X.is_doi("d"), d=doi) is ok


def test_bibliography(spark):
    from marginalia.sources import bibtex

    text = "@article{Lund1987, author = {Ida Lund}, title = {Rain in {Alpine} Valleys}, journal = {Weather}, year = {1987}, doi = {10.5555/rain.1987}}\n@misc{X, title = \"t\", nodoi = {true}}\n% no-doi\n@book{Y, title={u}}\n@article{Z, doi={https://doi.org/10.1000/z}}"
    got = {r["key"]: r for r in bibtex.entries(docs(spark, text)).collect()}
    assert got["Lund1987"]["title"] == "Rain in {Alpine} Valleys" and got["Lund1987"]["year"] == 1987 and got["Lund1987"]["doi"] == "10.5555/rain.1987"
    assert got["X"]["skip"] and got["Y"]["skip"] and not got["Z"]["skip"]
    assert got["Z"]["doi"] == "10.1000/z"
    assert got["Z"]["line"] == 5


def test_journal_ids(spark):
    assert journals.profiles(spark).count() == 22
    assert one(spark, journals.journal_id("j"), j="PLOS ONE") == "plos-one"


def test_search_with_a_broken_pattern(spark):
    assert lines.search(docs(spark, "a (b", "c"), "(b", "doc_id").count() == 1


def test_sql_functions(spark):
    from marginalia import sql

    sql.register(spark)
    assert spark.sql("SELECT accept_all('a {++b++}{--c--}') AS v").first()["v"] == "a b"
    assert spark.sql("SELECT count(*) AS n FROM annotations('x {++a++} {~~b~>c~~}')").first()["n"] == 2
    assert spark.sql("SELECT new_text FROM text_changes('a b', 'a c')").first()["new_text"] == "c"


def test_nulls_and_empty_tables(spark):
    none = spark.createDataFrame([(1, None)], "doc_id long, text string")
    empty = none.limit(0)
    for rows in (none, empty):
        assert annotations.annotations(rows, "doc_id").count() == 0
        assert citations.citations(rows, "doc_id").count() == 0
        assert equations.equations(rows, "doc_id").count() == 0
        assert style.issues(rows, "doc_id").count() == 0
        assert threads.threads(rows, "doc_id").count() == 0


def test_docx(spark, tmp_path):
    import zipfile

    from marginalia.sources import docx

    w = 'xmlns:x="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:y="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:z="http://schemas.microsoft.com/office/word/2012/wordml"'
    body = f"""<x:document {w}><x:body><x:p><x:pPr><x:pStyle x:val="Heading2"/></x:pPr><x:r><x:t>Methods</x:t></x:r></x:p>
      <x:p><x:r><x:t>We </x:t></x:r><x:commentRangeStart x:id="0"/><x:r><x:t>used</x:t></x:r><x:r><x:t> A &amp; B</x:t></x:r><x:commentRangeEnd x:id="0"/><x:del><x:r><x:delText>old</x:delText></x:r></x:del><x:ins><x:r><x:t>new</x:t></x:r></x:ins></x:p>
      <x:tbl><x:tr><x:tc><x:p><x:r><x:t>a</x:t></x:r></x:p></x:tc><x:tc><x:p><x:r><x:t>b|c</x:t></x:r></x:p></x:tc></x:tr></x:tbl></x:body></x:document>"""
    comments = f'<x:comments {w}><x:comment x:id="0" x:author="Ann" x:date="2024-01-02T03:04:05Z"><x:p y:paraId="P1"><x:r><x:t>why?</x:t></x:r></x:p></x:comment><x:comment x:id="1"><x:p y:paraId="P2"><x:r><x:t>because</x:t></x:r></x:p></x:comment></x:comments>'
    more = f'<z:commentsEx {w}><z:commentEx z:paraId="P2" z:paraIdParent="P1"/></z:commentsEx>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as f:
        f.writestr("word/document.xml", body)
        f.writestr("word/comments.xml", comments)
        f.writestr("word/commentsExtended.xml", more)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    files = docx.files(spark, str(tmp_path))
    got = {r["id"]: r for r in docx.read(files, "comments").collect()}
    assert got["0"]["author"] == "Ann" and got["0"]["date"] == "2024-01-02" and got["1"]["parent_id"] == "0" and got["1"]["author"] == "Unknown"
    assert docx.read(files, "anchors").first()["anchor"] == "used A & B"
    assert (docx.read(files, "headings").first()["level"], docx.read(files, "headings").first()["text"]) == (2, "Methods")
    assert "b\\|c" in docx.read(files, "tables").first()["markdown"]
    text = docx.read(files, "tracked_text").filter("path LIKE '%a.docx'").first()["text"]
    assert "## Methods" in text and "{~~old~>new~~}" in text
    assert {r["is_word"] for r in docx.read(files, "is_word").collect()} == {True, False}
    assert docx.read(files, "change_counts").filter("path LIKE '%a.docx'").first()["insertions"] == 1


def test_configuration():
    from marginalia.sources import config

    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert config.section_rows({"sections": {"m.md": {"header": "M", "order": 2}, "i.md": "I"}})[0][0] == "m.md"
    assert config.check({"n": "x"}, {"type": "object", "required": ["m"], "properties": {"n": {"type": "integer"}}}) == [".m: missing", ".n: is no integer"]


def test_files(spark, tmp_path):
    from marginalia.sources import text

    for name in ("b.md", "a.md", "README.md"):
        (tmp_path / name).write_text("# " + name)
    (tmp_path / "words").write_text("# remark\nFoo\nfoo\n\nbar\n")
    got = text.sections(text.whole_files(spark, str(tmp_path))).orderBy("ord").collect()
    assert [r["file"] for r in got] == ["a.md", "b.md"]
    assert {r["word"] for r in text.dictionary(spark, str(tmp_path / "words")).collect()} == {"foo", "bar"}


def test_sinks(spark, tmp_path):
    from marginalia.sources import sinks

    rows = spark.createDataFrame([(1, 'A "x"', "c", "ctx", True, "f.md", 3)], "number int, author string, content string, before string, resolved boolean, file string, line int")
    sinks.comments_csv(rows, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back["author"] == 'A "x"' and back["status"] == "resolved"


def test_words_of_a_manuscript(spark):
    assert one(spark, X.count_words("t"), t="---\ntitle: x\n---\n# Head\nSee [link](u) and ![i](p) @fig:a **bold** text") == 6


def test_case_insensitive_authors(spark):
    assert one(spark, X.surname("a"), a="Smith, John and Li, Bo") == "Smith"
    assert one(spark, F.concat_ws("|", X.authors("a")), a="J. Smith and B. Li") == "J. Smith|B. Li"


def without_orphans(text):
    """SCL-06 by going through the text mark by mark."""
    for sign in "+-~":
        end, out, k = sign * 2 + "}", "", 0
        while k < len(text):
            if text.startswith(end, k) and "{" + sign * 2 not in text[text.rfind("}", 0, k) + 1 : k] and "{" + sign * 2 not in out[out.rfind("}") + 1 :]:
                k += 3
            else:
                out, k = out + text[k], k + 1
        text = out
    return text


@pytest.mark.parametrize(
    "text, out",
    [
        ("a ++} b --} c ~~} d", "a  b  c  d"),
        ("a {++b++} c {--d--} e {~~f~>g~~}", "a {++b++} c {--d--} e {~~f~>g~~}"),
        ("a {++b {>>Ann: c<<}", "a b {>>Ann: c<<}"),
        ("a {--b {++c++}", "a b {++c++}"),
        ("a {~~b~>c", "a c"),
        ("{++}", "{"),
        ("plain", "plain"),
        ("", ""),
        (None, None),
    ],
)
def test_orphans(spark, text, out):
    assert one(spark, markup.without_orphans("text"), text=text) == out


def test_lone_ends_by_brute_force(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["a", " ", "++}", "--}", "~~}", "}", "b"]) for _ in range(r.randrange(12))) for _ in range(300)]
    got = docs(spark, *texts).select("doc_id", markup.without_orphans("text").alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in got] == [without_orphans(t) for t in texts]


def test_strip_of_very_long_texts(spark):
    plain = "words without an end " * 50_000
    assert one(spark, markup.stripped("text"), text=plain) == plain
    assert one(spark, markup.stripped("text"), text=plain + "{++x++}" + plain + "{--y--}") == plain + "x" + plain


def test_headings_of_sections(spark):
    config = spark.createDataFrame([("one.md", "Data and Study Area", ["sites"], 1), ("two.md", "Study Design", None, 2)], "file string, header string, aliases array<string>, ord int")
    titles = spark.createDataFrame([("study area and data",), ("Sites",), ("study design",), ("the study area data",), ("nothing",), (None,)], "title string")
    got = {r["title"]: r["file"] for r in sections.matched(titles, config).collect()}
    assert got == {"study area and data": "one.md", "Sites": "one.md", "study design": "two.md", "the study area data": "one.md", "nothing": None, None: None}


def test_conflicts_of_equal_keys(spark):
    """Changes with the same place and number group alike whatever order they come in."""
    rows = [(1, "R1", 1, 7, "replace", 0, 9, "old", f"new{k}") for k in range(6)]
    names = "doc_id long, reviewer string, reviewer_ord int, seq long, type string, start int, end int, old_text string, new_text string"
    one_way, other_way = (merging.conflict_summary(merging.conflicts(spark.createDataFrame(r, names), "doc_id"), "doc_id").collect() for r in (rows, rows[::-1]))
    assert one_way == other_way


REGISTRY = [("fig", "1", "rain", "Daily rain", "img/rain.png"), ("tbl", "S2", "sites", "Sites", "img/sites.png")]


@pytest.mark.parametrize(
    "text, restored",
    [
        ("see [Figure]{.mark} [1]{.mark} and [Table]{.mark}[S2]{.mark}", "see @fig:rain and @tbl:sites"),
        ("see [Figure]{.mark} [9]{.mark}", "see @fig:fig9"),
        ("see Fig. 1, table S2 and Figure 9", "see @fig:rain, @tbl:sites and Figure 9"),
        ("Figure 1: a caption", "Figure 1: a caption"),
        ("![Figure 1: old](media/a.png) then ![Fig. 1: again](media/b.png){#x}", "![Daily rain](img/rain.png){#fig:rain} then ![Daily rain](img/rain.png)"),
        ("![Figure 7. own words](media/a.png){width=3}", "![own words](media/a.png)"),
        ("![rain](a.png)\n\nFigure 7: said again", "![rain](a.png)"),
        ("", ""),
        (None, None),
    ],
)
def test_references_restored(spark, text, restored):
    from marginalia.operators import importing

    rows = spark.createDataFrame([("p", *r) for r in REGISTRY], "p string, kind string, num string, label string, caption string, path string")
    own = spark.createDataFrame([(text,)], "t string").crossJoin(importing.registries(rows, "p"))
    assert own.select(importing.references_restored("t", F.col("registry")).alias("v")).first()["v"] == restored


def test_import_of_files(spark):
    """Tracked, compared, plain and broken files in one job; references by each file's registry; counts."""
    from marginalia.operators import importing
    from marginalia.plans.word_queries import word_file

    rows = [(f"{k}.docx", word_file(k, text)) for k, text in ((0, "As Figure 1 has it."), (1, "So it is\nsaid (Lund 1987)."), (2, "Alone."), (3, ""))] + [("empty.docx", b""), ("null.docx", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    originals = spark.createDataFrame([("1.docx", "So it **is**\n\nsaid [@Lund1987].\n\nRain fell {++often ++}on the long pass today."), ("3.docx", "x"), ("9.docx", "no such file")], "path string, text string")
    registry = spark.createDataFrame([("0.docx", "fig", "1", "rain", "Daily rain", "img/rain.png")], "path string, kind string, num string, label string, caption string, picture string")
    got = {r["path"]: r for r in importing.imported(files, originals, registry).collect()}
    assert len(got) == 6
    assert got["0.docx"]["text"] == "As @fig:rain has it.\n\nRain {++heavily ++}fellx0{>>Ann: look<<} {--on--} here"
    assert [got["0.docx"][c] for c in ("way", "insertions", "deletions", "substitutions", "comments")] == ["tracked", 1, 1, 0, 1]
    assert got["1.docx"]["text"] == "So it **is**\n\nsaid [@Lund1987].\n\nRain fell {--often --}on {~~the~>a~~} long pass today."
    assert got["2.docx"]["text"].startswith("Alone.\n\nMethods 2\n\n| Sitex2 | Rain |\n| --- | --- |\n| Hill | sumx2 |") and got["2.docx"]["way"] == "plain"
    assert {p for p, r in got.items() if r["error"]} == {"3.docx", "empty.docx", "null.docx"} and got["3.docx"]["text"] is None
    assert importing.imported(files.limit(0), originals).count() == 0


def test_session_state_expires_and_resumes(spark, tmp_path):
    """Idle users' state goes; a second run goes on behind the first, with what the first has kept."""
    from marginalia.streaming import watch

    def arrive(name, *rows):
        made = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = watch.watched(spark, str(tmp_path / "in" / "*"), "event_id long, user_id long, ts timestamp")
        rows = watch.written(watch.last_of_sessions(stream, most=2, idle="1 hour", late="10 minutes"), str(tmp_path / "out"))
        return sorted((r["user_id"], r["kept"], r["newest"], r["closed"]) for r in rows.collect())

    arrive("a", (1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 00:01:00"), (3, 7, "2024-01-01 00:02:00"), (4, 8, "2024-01-01 00:30:00"))
    first = run()
    assert first == [(7, 2, 3, False), (8, 1, 4, False)]
    arrive("b", (5, 8, "2024-01-01 01:20:00"))
    second = run()
    assert set(second) - set(first) == {(8, 2, 5, False), (7, 2, 3, True)}
    arrive("c", (6, 7, "2024-01-01 01:25:00"))
    assert (7, 1, 6, False) in run()  # begins anew


@pytest.mark.parametrize("text, argument", [("x \\caption{a {b} c} d", "a {b} c"), ("\\caption \n{a \\} b}", "a \\} b"), ("\\caption[short]{a}", None), ("\\caption{open {", None), ("none", None), ("\\caption{}", ""), (None, None)])
def test_braced_argument(spark, text, argument):
    from marginalia.functions import markdown

    assert one(spark, markdown.braced("t", "\\caption"), t=text) == argument


def test_snapped_and_past_headings(spark):
    """Against a walk over the characters, for every offset of some texts."""

    def walk(t, p):
        if p <= 0:
            return 0
        if p >= len(t):
            return len(t)
        for d in range(51):
            for q in (p + d, p - d):
                if 0 <= q < len(t) and t[q].isspace():
                    return q
        return p

    texts = ["one two  three", "x" * 130 + " y", "a " + "b" * 120, "lead\n## Rain\n\n\nfell here", "# Only", "no heading"]
    rows = [(t, p) for t in texts for p in range(-1, len(t) + 2)]
    df = spark.createDataFrame(rows, "t string, p int").select("t", "p", anchors.snapped("t", "p").alias("s"), anchors.past_heading("t", "p").alias("h"))
    for r in df.collect():
        assert r["s"] == walk(r["t"], r["p"]), (r["t"], r["p"])
        m = re.search(r"(?m)^#{1,6}\s.+$", r["t"])
        inside = m and not (r["p"] > 0 and r["p"] >= m.end())
        assert r["h"] == (m.end() + len(re.match(r"[\r\n]*", r["t"][m.end() :])[0]) if inside else r["p"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("| A | Prior |\n|--|--|\n| x | Normal(0, 1) |", "| A | Prior |\n|--|--|\n| x | $\\mathcal{N}(0, 1)$ |\n"),
        ("| A | Other |\n|--|--|\n| x | Normal(0, 1) |", None),
        ("| A | Prior |\n| x | Normal(0, 1) |", None),
        ("| prior |\r\n|--|\r\n| Gamma(1) |\r\n|  |\r\nend", "| prior |\r\n|--|\r\n| $\\text{Gamma}(1)$ |\n|  |\nend"),
        ("|a|PRIOR|\n|-|-|\n|Normal(1)|\n|Normal(1)|Student-t(3, a)|more|", "|a|PRIOR|\n|-|-|\n|Normal(1)|\n|Normal(1)| $t_{3}(a)$ |more|\n"),
        ("", None),
        (None, None),
    ],
)
def test_tables_kept_whole(spark, text, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(markdown.tables_kept_whole("x", ["prior"])).first()[0] == (text if want is None else want)
    assert df.select(markdown.tables_kept_whole("x", ["prior"], "docx")).first()[0] == text
    assert df.select(markdown.tables_kept_whole("x", [])).first()[0] == text


def test_long_table(spark):
    rows = "".join(f"| {k} | Normal({k}) |\n" for k in range(20000))
    got = spark.createDataFrame([("| a | prior |\n|-|-|\n" + rows,)], "x string").select(markdown.tables_kept_whole("x", ["prior"])).first()[0]
    assert got == "| a | prior |\n|-|-|\n" + re.sub(r"Normal\((\d+)\)", r"$\\mathcal{N}(\1)$", rows)


def test_conflict_markers(spark):
    """Overlapping conflicts are put in from the last to the first, like slices of a string."""
    names = "doc_id long, conflict string, place int, reviewer string, type string, start int, end int, old_text string, new_text string"
    found = [(1, "c1", 0, "A", "replace", 4, 7, "two", "zwei"), (1, "c1", 1, "B", "delete", 4, 9, "two t", ""), (1, "c2", 1, "B", "insert", 8, 8, "", "in"), (1, "c2", 0, "A", "insert", 8, 8, "", "an"), (1, None, 0, "A", "insert", 0, 0, "", "free")]
    texts = spark.createDataFrame([(1, "one two three"), (2, "untouched"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in figures.conflict_markers(spark.createDataFrame(found, names), texts, "doc_id").collect()}
    text = "one two three"
    for start, end, marks in ((8, 8, "<<<<<<< CONFLICT c2\n======= A\nan\n======= B\nin\n>>>>>>> END c2"), (4, 9, '<<<<<<< CONFLICT c1\n======= A\nzwei\n======= B\n[DELETED: "two t"]\n>>>>>>> END c1')):
        text = text[:start] + marks + text[end:]
    assert got == {1: text, 2: "untouched", 3: None}


def test_sections_of_a_list(spark):
    listed = spark.createDataFrame([("p", ["a_long-name.md", None, "b.md", "a_long-name.md"]), ("q", ["x.md"]), (None, ["b.md"])], "project string, files array<string>")
    texts = spark.createDataFrame([("p", "b.md", "words\n### Third \n# First"), (None, "b.md", "#none\n# "), ("q", "x.md", "# X")], "project string, file string, text string")
    own = spark.createDataFrame([("q", "y.md", "Why", None, None)], "project string, file string, header string, aliases array<string>, ord int")
    got = {tuple(r) for r in sections.resolved(own, listed, texts, "project").withColumn("aliases", F.size("aliases")).collect()}
    assert got == {("p", "a_long-name.md", "A Long Name", 0, 3, "derived"), ("p", "b.md", "Third", 0, 2, "derived"), (None, "b.md", "B", 0, 0, "derived"), ("q", "y.md", "Why", 0, None, "own")}
