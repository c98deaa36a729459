"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under the frequent one.

The words' trie and the trie of the reversed words get numbered nodes, so that a word cut in two is a pair of whole
numbers: the node of its beginning and the node of its ending. Leaving out one character gives a pair (skip), and so does
leaving a place for one (insert). Words with equal skip pairs differ in one replaced character; a skip pair equal to an
insert pair means that one word is the other with a character more. Pairs meet by one grouping, and a group holds
at most one word for each character of the alphabet and one more, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import blocks, clearing, documents, map_arrow, prepare, saved

#: Words of at least LEAST_CHARS code points that occur LEAST_COUNT times; a form is FORM_TIMES as frequent as its variant.
LEAST_CHARS, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: One in DAMAGED runs, by its hash, loses a character before it is counted.
DAMAGED = 31
#: Words that one task numbers at a time.
PART_WORDS = 100_000
#: Different words that a task counts before it hands its counts on.
_COUNTED = 200_000
_ID_BITS = 33  # of monotonically_increasing_id below the number of the partition


def _counts(least: int, damaged: int):
    find = re.compile(rf"[A-Za-zÀ-ÿ]{{{least},}}").findall  # from its start, a run that is long enough is taken whole

    def run(batches):
        seen: Counter[str] = Counter()
        crc = zlib.crc32

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for b in blocks(batch):
                for doc, text in zip(b.column(0).to_pylist(), pc.ascii_lower(b.column(1)).to_pylist(), strict=True):
                    words = find(text) if text else ()
                    seen.update(words)
                    own: Counter[str] | None = None
                    start = crc(b"%d:" % doc if doc is not None else b":")
                    for w in set(words):
                        h = crc(w.encode(), start)
                        if not h % damaged:
                            own = own or Counter(words)
                            n, at = own[w], h % len(w)
                            seen[w] -= n
                            if not seen[w]:
                                del seen[w]
                            if len(w) > least:
                                seen[w[:at] + w[at + 1 :]] += n
                if len(seen) >= _COUNTED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damaged: int = DAMAGED) -> DataFrame:
    """word, n of the words of docs: see spelling_variants."""
    prepare(docs.sparkSession)
    counted = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _counts(least_chars, damaged), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _number(shared: dict[str, int]):
    """The trie nodes on each word's path, from the root; shared beginnings have their number, others one of this part."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("spelt")
        fresh = key[0].as_py() << _ID_BITS
        paths, word, path = [], "", [shared[""]]
        for w in group["spelt"].to_pylist():
            same = 0
            for a, b in zip(word, w, strict=False):
                if a != b:
                    break
                same += 1
            path = path[: same + 1]
            for d in range(same + 1, len(w) + 1):
                node = shared.get(w[:d])
                if node is None:
                    node, fresh = fresh, fresh + 1
                path.append(node)
            word = w
            paths.append(path)
        return pa.Table.from_arrays([group["wid"], pa.array(paths, pa.list_(pa.int64()))], names=["wid", "path"])

    return run


def _ranged(words: DataFrame, spelt, parts: int) -> DataFrame:
    """words in the order of spelt, cut into parts: spelt, its place (part << 33 | row in it) and the other columns."""
    ranged = words.withColumn("spelt", spelt).repartitionByRange(parts, "spelt").sortWithinPartitions("spelt")
    return saved(ranged.withColumn("place", F.monotonically_increasing_id()), "ranged")


def _paths(ranged: DataFrame) -> DataFrame:
    """wid and path, the numbered trie nodes of ranged(spelt, place, wid).

    A beginning that words of two parts share is a beginning of the later part's first word, so it is enough to number
    those of all first words beforehand: a row for each part.
    """
    part = F.shiftright("place", _ID_BITS)
    firsts = [r["w"] for r in ranged.groupBy(part.alias("p")).agg(F.min("spelt").alias("w")).collect()]
    begun = sorted({w[:d] for w in firsts for d in range(len(w) + 1)} | {""})
    shared = {b: -1 - i for i, b in enumerate(begun)}
    return ranged.select(part.alias("part"), "spelt", "wid").groupBy("part").applyInArrow(_number(shared), "wid bigint, path array<bigint>")


_INSERT, _SKIP, _LEAD = 0, 1, 2


def _pairs(words: DataFrame, begins: DataFrame, ends: DataFrame) -> DataFrame:
    """b, e (nodes of beginning and ending), wid, n, kind: the skip and insert pairs of each word.

    Leaving out any of some equal neighbours gives one word; the first of them leads, so each pair of words that differ
    by a character more meets once.
    """
    both = words.join(begins.withColumnRenamed("path", "b"), "wid").join(ends.withColumnRenamed("path", "e"), "wid")
    size = F.length("word")
    letter = lambda i: F.substring("word", i, F.lit(1))

    def skip(i):
        lead = (i == 0) | (letter(i) != letter(i + 1))
        return F.struct(F.get("b", i).alias("b"), F.get("e", size - 1 - i).alias("e"), F.when(lead, _LEAD).otherwise(_SKIP).alias("kind"))

    def insert(i):
        return F.struct(F.get("b", i).alias("b"), F.get("e", size - i).alias("e"), F.lit(_INSERT).alias("kind"))

    every = F.concat(F.transform(F.sequence(F.lit(0), size - 1), skip), F.transform(F.sequence(F.lit(0), size), insert))
    return both.select("wid", "n", F.explode(every).alias("p")).select("p.b", "p.e", "p.kind", "wid", "n")


def _near(pairs: DataFrame) -> DataFrame:
    """wid, n_near, best (n, -wid): for each word how many words are near, and the most frequent of them, the first of equals."""
    met = pairs.groupBy("b", "e").agg(F.collect_list(F.struct("wid", "n", "kind")).alias("m")).where(F.size("m") > 1)

    def around(x):
        differ = lambda y: (y["wid"] != x["wid"]) & F.when(x["kind"] == _INSERT, y["kind"] == _LEAD).when(x["kind"] == _SKIP, y["kind"] != _INSERT).otherwise(True)
        others = F.transform(F.filter("m", differ), lambda y: F.struct(y["n"].alias("n"), (-y["wid"]).alias("back")))
        return F.struct(x["wid"].alias("wid"), F.size(others).cast("long").alias("k"), F.array_max(others).alias("best"))

    each = met.select(F.explode(F.transform("m", around)).alias("a")).select("a.*").where("k > 0")
    return each.groupBy("wid").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """links (wid, to), each followed to its end, where no path has more than `steps` links: its length doubles each round."""
    for _ in range((steps - 1).bit_length() if steps > 1 else 0):
        more = links.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        links = saved(links.join(more, "to", "left").select("wid", F.coalesce("next", "to").alias("to")), "roots")
    return links


def variants(counts: DataFrame, form_times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of different, non-empty words with their counts: see spelling_variants."""
    spark = counts.sparkSession
    prepare(spark)
    with clearing(spark):
        counts = saved(counts.select("word", "n"), "counts")
        told = counts.agg(F.count("*").alias("words"), F.max("n").alias("most")).first()
        parts = max(1, -(-told["words"] // PART_WORDS))
        ranged = _ranged(counts, F.col("word"), parts).withColumn("wid", F.col("place"))  # falls and rises with the word's code points
        words = ranged.select("wid", "word", "n")
        back = _ranged(words, F.reverse("word"), parts)
        near = _near(_pairs(words, _paths(ranged), _paths(back)))
        fit = F.col("best.n") >= form_times * F.col("n")
        formed = words.join(near, "wid", "left").select("wid", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fit, -F.col("best.back")).alias("to"), F.when(fit, F.col("best.n")).alias("form_n"))
        formed = saved(formed, "formed")
        steps = 0  # each link leads to a word that is form_times as frequent
        while form_times ** (steps + 1) * LEAST_COUNT <= (told["most"] or 0):
            steps += 1
        links = formed.where("to is not null").select("wid", "to")
        ends = _roots(links, steps).select("wid", F.col("to").alias("end"))
        named = formed.select(F.col("wid").alias("to"), F.col("word").alias("form"))
        found = links.join(ends, "wid").join(named, "to").join(named.toDF("end", "root"), "end").select("wid", "form", "root")
        out = formed.join(found, "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return saved(out, "variants", keep=True)


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of docs: word, form, root, n, n_near, form_n.

    Runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, are words if they have at least 7 code points and
    occur at least twice over all texts. Of a run whose crc32 with its document's id (none before the colon for a null id) is a multiple
    of 31 one character is deleted first. Near words differ by one character; the form of a word is its most frequent near word
    (of equals the first by code points) if that is ten times as frequent, else null, like form_n; root follows forms to
    the last. Null and empty texts have no words; repeated rows count again; extra columns are ignored; an empty table gives no rows.
    """
    return variants(word_counts(docs))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and the forms that they are variants of: see spelling_variants."""
    return spelling_variants(documents(spark, sf_dir))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
ORACLE_SQL: dict[str, str] = {}
