"""Surname, given name and patronymic from noisy text: label anchors, dictionary search, suffixes, position.

The dictionary search is a distributed join over the distinct words of all scans; the rest are expressions over a
scan's lines, with the words' matches at hand in a map. Rules that depend on what was found earlier compare line numbers: what
a surname's line excludes is known once the first line with a surname is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idloom.functions import text as T
from idloom.functions.text import once
from idloom.operators.fuzzy import fuzzy_find
from idloom.session import checkpointed

#: Words beside a label that are looked up in the dictionary, and the largest page that is read by position.
CANDIDATES, FEW_WORDS = 8, 8
#: How far from an entry a word may be: names, and the patronymic at its label.
NEAR, NEAR_PATRONYMIC = 2, 3
#: Matches of words that are broadcast, in bytes; beyond, those of so many of the most common words are.
MATCH_BYTES, FREQUENT = 64 << 20, 1000
_SURNAME, _NAME, _PATRONYMIC = "ФАМИЛИ", "ИМЯ", "ОТЧЕСТВ"
# Scores of a patronymic at its label by suffix and without, by suffix in the text and by position; of a surname and name by position.
LABELLED_SUFFIX, LABELLED_WORD, SUFFIX, PLACED_PATRONYMIC, PLACED_SURNAME, PLACED_NAME = 0.9, 0.6, 0.8, 0.75, 0.4, 0.35


def extract_fio_latin(lines: Column) -> Column:
    """struct(surname, name, patronymic, confidence): by position, after the line with a patronymic ending is set aside."""
    words = F.filter(F.transform(F.filter(lines, lambda x: ~T.is_latin_label(x)), T.latin_words), lambda w: F.size(w) > 0)
    has = lambda ws: F.exists(ws, T.is_latin_patronymic)
    flags = F.transform(words, has)
    at = F.array_position(flags, F.lit(True))
    patronymic = F.coalesce(F.get(F.filter(F.flatten(words), T.is_latin_patronymic), F.lit(0)), F.lit(""))
    rest = F.filter(words, lambda w, i: i + 1 != at)
    word = lambda line, k: F.coalesce(F.get(F.get(rest, F.lit(line)), F.lit(k)), F.lit(""))
    surname, name = word(0, 0), T.first_set(word(1, 0), word(0, 1))
    long = lambda c, n: F.when(F.length(c) > 2, n).otherwise(0)
    return F.struct(T.to_title(surname).alias("surname"), T.to_title(name).alias("name"), T.to_title(patronymic).alias("patronymic"), (long(surname, 40) + long(name, 35) + long(patronymic, 25)).alias("confidence"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _behind(line: Column, label: str) -> Column:
    """The words after the first occurrence of label."""
    at = F.instr(line, label)
    return F.when(at > 0, T.cyr_words(F.substr(line, at + len(label)))).otherwise(F.array().cast("array<string>"))


def _lines_where(is_anchor: Callable[[Column], Column]) -> Column:
    """Numbers of the lines that are anchors."""
    return F.filter(F.transform("lines", lambda x, i: F.when(is_anchor(x), i)), lambda i: i.isNotNull())


def _is_name_line(line: Column) -> Column:
    return line.rlike(T.whole(_NAME)) & ~F.contains(line, F.lit(_SURNAME))


def _at_labels(label: str, is_anchor: Callable[[Column], Column], kind: str, without: Callable[[Column, Column], Column]) -> Column:
    """struct(line, word, dist, raw_word) of the first line with the label that has a word behind or beside it.

    Words behind the label come first, then those of the lines around, the nearest and longest first. Of the first eight the one
    nearest to the dictionary gives its entry; with none near enough the first of all is taken as it is.
    """
    empty = F.array().cast("array<struct<d:int,n:int,at:int,w:string>>")

    def placed(words: Column, distance: int, turn: int) -> Column:
        return F.transform(words, lambda w, k: F.struct(F.lit(distance).alias("d"), (-F.length(w)).alias("n"), (k + turn * 1_000_000).alias("at"), w.alias("w")))

    def around(i: Column) -> Column:
        parts = [placed(_behind(F.get("lines", i), label), 0, 0)]
        for turn, d in enumerate((1, -1, 2, -2, 3, -3), 1):
            there = (i + d >= 0) & (i + d < F.size("lines")) & ~F.get("label", i + d)
            parts.append(F.when(there, placed(F.get("words", i + d), abs(d), turn)).otherwise(empty))
        return F.array_sort(F.filter(F.concat(*parts), lambda x: ~T.is_label(x["w"]) & without(i, x["w"])))

    def read(i: Column, near: Column) -> Column:
        hit = lambda w: F.col("hits")[w][kind]
        tried = F.transform(F.slice(near, 1, CANDIDATES), lambda x, k: F.struct(hit(x["w"])["dist"].alias("dist"), k.alias("k"), hit(x["w"])["match"].alias("word"), x["w"].alias("raw_word")))
        known = F.array_min(F.filter(tried, lambda x: x["dist"].isNotNull() & (x["dist"] <= NEAR)))
        first = _first(near)["w"]
        found = _let(known, lambda b: F.struct(i.alias("line"), F.coalesce(b["word"], first).alias("word"), F.coalesce(b["dist"], F.lit(T.NOT_IN_DICTIONARY)).alias("dist"), F.coalesce(b["raw_word"], first).alias("raw_word")))
        return F.when(F.size(near) > 0, found)

    return _first(F.filter(F.transform(_lines_where(is_anchor), lambda i: _let(around(i), lambda near: read(i, near))), lambda x: x.isNotNull()))


def _taken(found: Column, i: Column, strictly: bool) -> Column:
    """The word that found excludes on line i: none before its own line."""
    return F.coalesce(F.when(found["line"] < i if strictly else found["line"] <= i, F.upper(found["word"])), F.lit(""))


def _patronymic_at_label() -> Column:
    """struct(line, word, dist, raw_word, score): of the words around the label the first with the suffix, else the first long one."""

    def read(i: Column, free: Column) -> Column:
        by_suffix = _first(F.filter(free, T.is_patronymic))
        w = F.coalesce(by_suffix, _first(F.filter(free, lambda w: (F.length(w) >= 5) & ~T.is_label(w))))

        def corrected(w: Column) -> Column:
            hit = F.col("hits")[w]["p"]
            return F.struct(i.alias("line"), F.coalesce(hit["match"], w).alias("word"), F.coalesce(hit["dist"], F.lit(T.NOT_IN_DICTIONARY)).alias("dist"), w.alias("raw_word"), F.when(T.is_patronymic(w), LABELLED_SUFFIX).otherwise(LABELLED_WORD).alias("score"))

        return _let(w, lambda w: F.when(w.isNotNull(), corrected(w)))

    def free(i: Column) -> Column:
        near = F.concat(*(F.when((i + d >= 0) & (i + d < F.size("lines")), F.get("words", i + d)).otherwise(F.array().cast("array<string>")) for d in (0, 1, -1, 2, -2)))
        return F.filter(near, lambda w: (w != _taken(F.col("surname_at"), i, False)) & (w != _taken(F.col("name_at"), i, False)))

    return _first(F.filter(F.transform(_lines_where(lambda x: F.contains(x, F.lit(_PATRONYMIC))), lambda i: _let(free(i), lambda f: read(i, f))), lambda x: x.isNotNull()))


def _in_text(kind: str, *others: Column) -> Column:
    """struct(word, score) of the word of the text nearest to the dictionary, the first in reading order of equals, but for others."""
    hit = lambda w: F.col("hits")[w][kind]
    near = F.transform("candidates", lambda w, k: F.struct(hit(w)["dist"].alias("dist"), k.alias("k"), hit(w)["match"].alias("word"), w.alias("w")))

    def free(x: Column) -> Column:
        fit = x["dist"].isNotNull() & (x["dist"] <= NEAR)
        for o in others:
            fit = fit & (x["w"] != o)
        return fit

    return _let(F.array_min(F.filter(near, free)), lambda b: F.when(b.isNotNull(), F.struct(F.upper(b["word"]).alias("word"), T.dist_to_score(b["dist"]).alias("score"))))


def _scored(word: Column, score: Column | float) -> Column:
    return F.when(word.isNotNull(), F.struct(word.alias("word"), (score if isinstance(score, Column) else F.lit(score)).alias("score")))


def _word(found: Column) -> Column:
    return F.coalesce(found["word"], F.lit(""))


_ANCHORS = "array<struct<part:string,word:string,dist:int,raw_word:string>>"
_OUT = ("scan_id", "surname", "name", "patronymic", "confidence", "strategy", "cleaned", "candidates", "anchors")


def read_names(pages: DataFrame) -> DataFrame:
    """The names of pages(scan_id, cleaned, lines, label, words, hits): see extract_fio.

    label says which lines are labels, words holds the words of each line, hits maps a word to its matches: s, mf and p, each
    struct<match, dist>.
    """
    df = once(pages, surname_at=_at_labels(_SURNAME, lambda x: F.contains(x, F.lit(_SURNAME)), "s", lambda i, w: F.lit(True)))
    df = once(df, name_at=_at_labels(_NAME, _is_name_line, "mf", lambda i, w: w != _taken(F.col("surname_at"), i, True)))
    df = once(df, patronymic_at=_patronymic_at_label(), candidates=F.flatten(F.filter("words", lambda ws, i: ~F.get("label", i))))
    anchored = lambda c: _scored(F.upper(c["word"]), T.anchor_score(c["dist"]))
    df = once(df, sn=F.coalesce(anchored(F.col("surname_at")), _in_text("s")))
    df = once(df, nm=F.coalesce(anchored(F.col("name_at")), _in_text("mf", _word(F.col("sn")))))
    sn, nm, pt = F.col("sn"), F.col("nm"), F.col("pt")
    at = F.col("patronymic_at")
    by_suffix = _first(F.filter("candidates", lambda w: (w != _word(sn)) & (w != _word(nm)) & T.is_patronymic(w)))
    df = once(df, pt=F.coalesce(_scored(F.upper(at["word"]), at["score"]), _in_text("p", _word(sn), _word(nm)), _scored(by_suffix, SUFFIX)))
    anchor = F.col("surname_at").isNotNull() | F.col("name_at").isNotNull() | at.isNotNull()
    df = once(df, groups=F.when(sn.isNull() & ~anchor & F.size("candidates").between(1, FEW_WORDS), F.filter("words", lambda ws, i: ~F.get("label", i) & (F.size(ws) > 0))))
    df = once(df, aside=F.array_position(F.transform("groups", lambda ws: F.exists(ws, T.is_patronymic)), F.lit(True)))
    rest = F.filter("groups", lambda ws, i: i + 1 != F.col("aside"))
    line = lambda k: F.get(F.get(rest, F.lit(k)), F.lit(0))
    placed = _first(F.filter(F.get("groups", F.col("aside").cast("int") - 1), T.is_patronymic))
    df = once(df, s=F.coalesce(sn, _scored(line(0), PLACED_SURNAME)), n=F.coalesce(nm, _scored(line(1), PLACED_NAME)), p=F.coalesce(pt, F.when(F.col("aside") > 0, _scored(placed, PLACED_PATRONYMIC))), anchor=anchor)
    score = lambda c: F.coalesce(F.col(c)["score"], F.lit(0.0))
    strategy = F.when(F.col("anchor"), "anchor").when(sn.isNull() & F.col("s").isNotNull(), "positional").otherwise("scan")
    shown = lambda c, part: F.when(F.col(c).isNotNull(), F.array(F.struct(F.lit(part).alias("part"), *(F.col(c)[f].alias(f) for f in ("word", "dist", "raw_word"))))).otherwise(F.array().cast(_ANCHORS))
    anchors = F.concat(shown("name_at", "name"), shown("patronymic_at", "patronymic"), shown("surname_at", "surname")).cast(_ANCHORS)
    names = {part: T.to_title(_word(F.col(c))) for part, c in (("surname", "s"), ("name", "n"), ("patronymic", "p"))}
    confidence = T.round_half_up((score("s") + score("n") + score("p")) / 3 * 100).cast("int")
    return df.select("scan_id", *(c.alias(k) for k, c in names.items()), confidence.alias("confidence"), strategy.alias("strategy"), "cleaned", "candidates", anchors.alias("anchors"))


def _matches(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """scan_id, hits: for words(scan_id, w) the map from each word near the dictionary to its matches.

    The matches are written once, as far as they go: words that are near nothing have none. Up to MATCH_BYTES of them are
    broadcast to the words. Beyond, words that many scans share would meet in one task, so the matches of the
    FREQUENT most common ones are broadcast and only the others are joined by a shuffle.
    """
    different = checkpointed(words.select("w").distinct())
    names = fuzzy_find(different, dictionary.where("kind <> 'p'"), NEAR)
    near = names.union(fuzzy_find(different, dictionary.where("kind = 'p'"), NEAR_PATRONYMIC))
    hit = lambda c: F.struct(c["match"].alias("match"), c["dist"].alias("dist"))
    best = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.struct("dist", (F.col("kind") != kinds[0]).alias("later"), "match")))
    near = near.groupBy("w").agg(best("s").alias("s"), best("m", "f").alias("mf"), best("p").alias("p"))
    near = checkpointed(near.select("w", F.struct(*(F.when(F.col(k).isNotNull(), hit(F.col(k))).alias(k) for k in ("s", "mf", "p"))).alias("hit")))
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0))
    held = near.agg(F.coalesce(F.sum(200 + size("w") + size("hit.s.match") + size("hit.mf.match") + size("hit.p.match")), F.lit(0))).first()[0]
    if held <= MATCH_BYTES:
        met = words.join(F.broadcast(near), "w")
    else:
        frequent = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(FREQUENT).collect()]
        often = F.col("w").isin(frequent)
        met = words.where(~often).join(near.where(~often), "w").union(words.where(often).join(F.broadcast(near.where(often)), "w"))
    return met.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "hit"))).alias("hits"))


def extract_fio(scans: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names of scans(scan_id, full_text): scan_id, surname, name, patronymic, confidence, strategy, cleaned, candidates, anchors.

    cleaned is the text as searched, candidates its words outside label lines, anchors what stood at labels. Latin
    pages have neither. dictionary(kind, ord, entry) holds surnames (s), male (m) and female names (f) and patronymics (p).
    """
    read = once(scans.select("scan_id", "full_text"), cleaned=T.clean_ocr_text(F.col("full_text"))).drop("full_text")
    read = once(read, lines=T.split_lines(F.col("cleaned")), lang=T.detect_lang(F.col("cleaned")))
    latin = once(read.where("lang = 'latin'"), r=extract_fio_latin(F.col("lines")))
    latin = latin.select("scan_id", "r.surname", "r.name", "r.patronymic", F.col("r.confidence").cast("int").alias("confidence"), F.lit("latin").alias("strategy"), "cleaned", F.array().cast("array<string>").alias("candidates"), F.array().cast(_ANCHORS).alias("anchors"))
    pages = once(read.where("lang = 'cyrillic'").select("scan_id", "cleaned", "lines"), label=F.transform("lines", T.is_label), words=F.transform("lines", T.cyr_words))
    # Of label lines only words behind labels, and those around a patronymic's label, are ever looked up.
    near_label = F.transform("lines", lambda x, i: F.exists(F.slice("lines", F.greatest(i - 1, F.lit(1)), F.lit(5)), lambda y: F.contains(y, F.lit(_PATRONYMIC))))
    own = F.filter("words", lambda ws, i: ~F.get("label", i) | F.get("near", i))
    behind = F.transform("lines", lambda x: F.concat(F.when(F.contains(x, F.lit(_SURNAME)), _behind(x, _SURNAME)).otherwise(F.array().cast("array<string>")), F.when(_is_name_line(x), _behind(x, _NAME)).otherwise(F.array().cast("array<string>"))))
    looked = once(pages.select("scan_id", "lines", "label", "words"), near=near_label)
    looked = looked.select("scan_id", F.explode(F.array_distinct(F.flatten(F.concat(own, behind)))).alias("w"))
    folded = read_names(pages.join(_matches(looked, dictionary), "scan_id", "left"))
    return folded.select(*_OUT).union(latin.select(*_OUT))
