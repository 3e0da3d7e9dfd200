"""Grammar, style and spelling (EXT-15..17, AGG-05, DIF-16)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEFT, RIGHT, chain, looks_like_name, strip
from .lines import is_fence, lines, state_before


class Rule(NamedTuple):
    id: str
    pattern: str
    severity: str
    message: str
    scientific: bool = False
    min_words: int = 0


def _begins(letters: str) -> str:
    """Only where one of these letters stands is anything else tried."""
    return f"(?=[{letters.lower()}{letters.upper()}])(?i){LEFT}"


def _any(words: str) -> str:
    letters = "".join(sorted({w[0].lower() for w in words.split("|")}))
    return f"{_begins(letters)}({words}){RIGHT}"


#: The rules.  \b and \w are written out for ASCII.
RULES = (
    Rule("passive-voice", f"{_begins('abiw')}(is|are|was|were|be|been|being)\\s+(being\\s+)?[A-Za-z0-9_]+ed{RIGHT}", "info", "Reads like the passive"),
    Rule("weasel-words", _any("very|really|quite|extremely|fairly|rather|somewhat|just"), "warning", "Vague intensifier"),
    Rule("weak-start", f"(?mi)^\\s*(There (is|are|was|were)|It is){RIGHT}", "info", "Sentence opens with an empty subject"),
    Rule("duplicate-words", f"(?=[A-Za-z0-9_])(?i){LEFT}([A-Za-z0-9_]++)\\s+\\1{RIGHT}", "error", "The same word twice in a row"),
    Rule("split-infinitive", f"{_begins('t')}to\\s+([A-Za-z0-9_]+ly)\\s+[A-Za-z0-9_]+{RIGHT}", "info", "Adverb inside an infinitive"),
    # starts only where a sentence does: a long text without an end is then looked through once
    Rule("sentence-length", r"(?<![^.!?])[^.!?]*+[.!?]", "warning", "Sentence of more than 40 words", False, 41),
    Rule("cliches", _any("at the end of the day|in terms of|it goes without saying|needless to say|as a matter of fact|first and foremost|last but not least"), "warning", "Worn phrase"),
    Rule("hedging", _any("seems to|appears to|tends to|might|may|could possibly|would seem"), "info", "Statement is hedged"),
    Rule("redundancy", _any("basic fundamentals|end result|free gift|future plans|past history|completely unique|absolutely essential|close proximity|each and every|first began|true fact|advance planning|final outcome"), "warning", "One word of this says it all"),
    Rule("first-person", _any("I|we|my|our"), "info", "Written in the first person", True),
    Rule("significant", f"{_begins('s')}significant(ly)?{RIGHT}(?!\\s+(P|p|α|difference|effect|increase|decrease|correlation))", "warning", "Significance named without a statistic", True),
    Rule("prove", _any("prove[ds]?|proof"), "warning", "Claims a proof", True),
    Rule("obviously", _any("obviously|clearly|of course"), "warning", "Calls something evident", True),
)
RANK = {"error": 3, "warning": 2, "info": 1}


def rules(spark) -> DataFrame:
    """EXT-16: the catalogue."""
    return spark.createDataFrame([r._asdict() for r in RULES], "id string, pattern string, severity string, message string, scientific boolean, min_words int")


def issues(docs: DataFrame, *keep: str, scientific: bool = True, dictionary: DataFrame | None = None) -> DataFrame:
    """EXT-15: one row per hit: kept columns, line, rule, severity, match, context.

    All rules are tried in one pass over the lines: an array of the hits of
    each rule, whose patterns are literals, then one explode.
    """
    text, bare = F.col("line_text"), strip("line_text")
    rows = lines(docs, *keep).filter((text != "") & ~is_fence(text) & ~bare.startswith("---") & ~(bare.rlike(r"^[#\-*>|]") & (F.length(bare) < 5)))

    def hits(r: Rule) -> Column:
        found = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        if r.min_words:
            found = F.filter(found, lambda m: F.size(F.split(strip(m), r"\s+")) >= r.min_words)
        return F.transform(found, lambda m: F.struct(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), m.alias("match")))

    own = [r for r in RULES if scientific or not r.scientific]
    out = rows.select(*keep, "line", bare.alias("context"), F.explode(F.flatten(F.array(*map(hits, own)))).alias("i")).select(*keep, "line", "i.*", "context")
    if dictionary is not None:
        out = out.join(dictionary.select(F.col("word").alias("_w")), F.lower("match") == F.col("_w"), "left_anti")
    return out


def summary(found: DataFrame) -> DataFrame:
    """AGG-05: hits by severity, by rule and in all."""
    return found.groupingSets([["severity"], ["rule"], []], "severity", "rule").agg(F.count("*").alias("n"))


def at_least(found: DataFrame, severity: str) -> DataFrame:
    """FLT-02."""
    rank = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return found.filter(rank >= RANK[severity])


#: File extensions that are no words.
EXTENSIONS = "md|tex|png|jpg|pdf|csv|js|py|html|css|yaml|json|docx|bib"
#: What a line loses before its words are looked at, in order.
CLEANUPS = (
    (r"`[^`]+`", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"@(fig|tbl|eq):[A-Za-z0-9_]+", ""),
    (r"\{[^}]+\}", ""),
    (r"https?://\S+", ""),
    (r"\$[^$]+\$", ""),
    (r"\\[A-Za-z0-9_]+", ""),
    (r"[#*_~`>|]", " "),
)
#: Words of a dictionary that goes to all tasks whole.
FEW_WORDS = 200_000
WORD = r"[a-zA-Z][a-zA-Z']*[a-zA-Z]|[a-zA-Z]"


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """EXT-17: one row per word to be checked: kept columns, line, place, word.

    Frontmatter and fenced lines are known by windows over the lines; words of
    a line keep their order.
    """
    rows = lines(docs, *keep).filter("line_text <> ''")
    bare = strip("line_text")
    order = Window.partitionBy(*keep).orderBy("line")
    dashes = (bare == "---").cast("int")
    opened = F.max(((F.col("line") == 1) & (bare == "---")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(dashes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("front", (opened == 1) & (closed < 2))
    fence = is_fence(F.col("line_text")) & ~F.col("front")
    rows = rows.withColumn("fence", fence).withColumn("inside", state_before(F.col("fence"), *keep))
    rows = rows.filter(~F.col("front") & ~F.col("fence") & ~F.col("inside") & ~bare.startswith("http") & ~bare.startswith("/"))
    found = rows.select(*keep, "line", F.posexplode(F.regexp_extract_all(chain("line_text", *CLEANUPS), F.lit(WORD), F.lit(0))).alias("place", "word"))
    w = F.col("word")
    return found.filter((F.length(w) >= 3) & ~w.rlike("^[A-Z]+$") & ~w.rlike(f"(?i)^({EXTENSIONS})$") & ~w.rlike("[a-z][A-Z]"))


def first_uses(found: DataFrame, *key: str) -> DataFrame:
    """WIN-09: the first use of each word, whatever its case."""
    w = Window.partitionBy(*key, F.lower("word")).orderBy("line", "place")
    return found.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def unknown(found: DataFrame, dictionary: DataFrame, *key: str) -> DataFrame:
    """DIF-16: words that the dictionary lacks, once each, with whether they look like names."""
    known = dictionary.select(F.col("word").alias("_w")).distinct()
    # known words go first, and where they are not sent to each other's tasks only lines are moved
    rest = found.withColumn("_w", F.lower("word")).join(F.broadcast(known) if known.count() <= FEW_WORDS else known, "_w", "left_anti")
    return first_uses(rest, *key).withColumn("is_name", looks_like_name("word")).drop("_w")


#: An affix rule: words with `flag` take the affix instead of `strip`, if their end (or beginning) is like `condition`; `cross` ones go with the other kind, too.
AFFIXES = "kind string, flag string, cross boolean, strip string, affix string, condition string"


def _undone(words: DataFrame, rules: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """Rows of words (word, rest, names...) with what each rule of the kind makes their rest from: base, rule's flag and cross.

    An affix is an end (or a beginning) of the word, so words meet rules by
    equal affixes, not by trying all of them.
    """
    own = rules.filter(F.col("kind") == kind).select("flag", "cross", F.coalesce("strip", F.lit("")).alias("strip"), F.coalesce("affix", F.lit("")).alias("affix"), F.coalesce("condition", F.lit(".")).alias("condition"))
    longest = own.agg(F.max(F.length("affix"))).first()[0] or 0
    n = F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.greatest(F.length("rest") - 1, F.lit(0))))).alias("n")
    cut = words.select("word", "rest", *names, n)
    end = F.right("rest", F.col("n")) if kind == "SFX" else F.left("rest", F.col("n"))
    stem = F.left("rest", F.length("rest") - F.col("n")) if kind == "SFX" else F.substr("rest", F.col("n") + 1)
    met = cut.select("word", *names, end.alias("affix"), stem.alias("stem")).join(own, "affix")
    base = F.concat("stem", "strip") if kind == "SFX" else F.concat("strip", "stem")
    fits = F.when(F.lit(kind == "SFX"), F.concat(F.lit("(?s)^.*"), "condition", F.lit("$"))).otherwise(F.concat(F.lit("(?s)^"), "condition"))
    return met.withColumn("base", base).filter(F.regexp_like("base", fits)).select("word", "base", *names, "flag", "cross")


def known_by_affixes(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """DIF-16: word and stem of the words that a stem dictionary with affix rules knows.

    stems: word, flags (array of strings); rules: AFFIXES.  A word is a stem
    itself, or a suffix or a prefix taken off leaves a stem that has its flag,
    or both do where both rules are `cross`.  Case does not count.
    """
    w = words.select(F.lower("word").alias("word")).distinct()
    known = stems.select(F.lower("word").alias("base"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    known = known.groupBy("base").agg(F.array_distinct(F.flatten(F.collect_list("flags"))).alias("flags"))
    plain = w.withColumn("rest", F.col("word"))
    suffixed, prefixed = (_undone(plain, rules, kind, []) for kind in ("SFX", "PFX"))
    both = _undone(suffixed.filter("cross").select("word", F.col("base").alias("rest"), F.col("flag").alias("first")), rules, "PFX", ["first"]).filter("cross")
    tried = w.select("word", F.col("word").alias("base"), F.array().cast("array<string>").alias("wanted"))
    for rows, flags in ((suffixed, F.array("flag")), (prefixed, F.array("flag")), (both, F.array("first", "flag"))):
        tried = tried.unionByName(rows.select("word", "base", flags.alias("wanted")))
    met = tried.join(known, "base").filter(F.size(F.array_except("wanted", "flags")) == 0)
    return met.groupBy("word").agg(F.min("base").alias("stem"))


def unknown_by_affixes(found: DataFrame, stems: DataFrame, rules: DataFrame, *key: str) -> DataFrame:
    """DIF-16: first uses of the words that neither are stems nor are made of one by the rules."""
    # no word is known but forms of the stems: as many as stems with and without each affix at most
    kinds = rules.agg(F.count_if(F.col("kind") == "SFX"), F.count_if(F.col("kind") == "PFX")).first()
    few = stems.count() * (1 + kinds[0]) * (1 + kinds[1]) <= FEW_WORDS
    ok = known_by_affixes(found.select("word"), stems, rules).select(F.col("word").alias("_w"))
    # known words go first, and where they are not sent to each other's tasks only lines are moved
    rest = found.withColumn("_w", F.lower("word")).join(F.broadcast(ok) if few else ok, "_w", "left_anti")
    return first_uses(rest, *key).withColumn("is_name", looks_like_name("word")).drop("_w")


def affix_rules(texts: DataFrame, text: str = "text") -> DataFrame:
    """AFFIXES of affix files: their lines `SFX flag strip affix condition`, and `cross` of the heads `SFX flag Y n`."""
    lines_ = texts.select(F.explode(F.split(text, r"\r?\n")).alias("l")).filter(F.col("l").rlike(r"^(SFX|PFX)\s"))
    f = lines_.select(F.split(F.trim("l"), r"\s+").alias("f"))
    heads = f.filter((F.size("f") == 4) & F.col("f")[2].isin("Y", "N")).select(F.col("f")[0].alias("kind"), F.col("f")[1].alias("flag"), (F.col("f")[2] == "Y").alias("cross")).distinct()
    own = f.filter((F.size("f") > 4) | ((F.size("f") == 4) & ~F.col("f")[2].isin("Y", "N")))

    def given(k: int) -> Column:
        return F.when(F.col("f")[k] == "0", "").otherwise(F.split_part(F.col("f")[k], F.lit("/"), F.lit(1)))

    rows = own.select(F.col("f")[0].alias("kind"), F.col("f")[1].alias("flag"), given(2).alias("strip"), given(3).alias("affix"), F.coalesce(F.get("f", F.lit(4)), F.lit(".")).alias("condition"))
    return rows.join(heads, ["kind", "flag"], "left").select("kind", "flag", F.coalesce("cross", F.lit(False)).alias("cross"), "strip", "affix", "condition")


def suggestions(wrong: DataFrame, dictionary: DataFrame, most: int = 2, top: int = 5) -> DataFrame:
    """SCL-26: the nearest dictionary words of each wrong word, at most `most` edits away.

    Words within k edits share a piece of one of them: a wrong word cut into
    k + 1 pieces has one that is untouched and, in the other word, at most k
    places off.  Both sides emit (piece, place, length), so that only words
    with such a piece in common are compared.
    """
    cut = most + 1

    def piece_size(n: Column) -> Column:
        return F.greatest(F.floor(n / cut), F.lit(1)).cast("int")

    own = wrong.select(F.lower("word").alias("wrong")).distinct().withColumn("n", F.length("wrong"))
    k = F.explode(F.sequence(F.lit(0), F.lit(cut - 1))).alias("k")
    own = own.select("wrong", "n", k).withColumn("at", F.col("k") * piece_size(F.col("n")))
    size = F.when(F.col("k") == cut - 1, F.greatest(F.col("n") - F.col("at"), F.lit(0))).otherwise(piece_size(F.col("n")))
    own = own.withColumn("piece", F.substr("wrong", F.col("at") + 1, size)).select("wrong", "n", "k", "piece", "at")
    shift = F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("d")
    known = dictionary.select(F.lower("word").alias("word")).distinct().select("word", shift).select("word", "d", F.explode(F.sequence(F.lit(0), F.lit(cut - 1))).alias("k"))
    lengths = F.explode(F.sequence(F.greatest(F.length("word") - most, F.lit(1)), F.length("word") + most)).alias("n")
    known = known.select("word", "d", "k", lengths).withColumn("at", F.col("k") * piece_size(F.col("n")))
    size = F.when(F.col("k") == cut - 1, F.greatest(F.col("n") - F.col("at"), F.lit(0))).otherwise(piece_size(F.col("n")))
    known = known.withColumn("from", F.col("at") + F.col("d")).filter("from >= 0").withColumn("piece", F.substr("word", F.col("from") + 1, size)).filter(F.length("piece") == size)
    pairs = own.join(known.select("word", "n", "k", "piece").distinct(), ["n", "k", "piece"]).select("wrong", "word").distinct()
    near = pairs.withColumn("distance", F.levenshtein("wrong", "word")).filter(F.col("distance").between(1, most))
    w = Window.partitionBy("wrong").orderBy("distance", "word")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
