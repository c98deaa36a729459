"""Near duplicates: SuperMinHash signatures, banding, exact verification and union-find grouping.

Documents are compared by their sets of word shingles: A-Z are lower-cased, words are runs without white
space, a shingle is `shingle` words in a row (all words of a shorter text; none of an empty or null text).
Two documents are linked if 100 * intersection >= percent * union; a group is what links connect. Sets are kept, and
links confirmed, as sets of 64-bit hashes of whole shingles.

Nodes are distinct sets, told apart by a 128-bit digest and their size. Tables that an aggregate and a join need by one key
are written in between, so that Spark can split the rows of a hot key among the tasks of the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm.common import _GOLD, _M2, Words, clearing, documents, map_batches, mix, prepare, raw_texts, saved
from idloom.llm.components import components
from idloom.llm.superminhash import band_keys, signatures

#: At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** ROWS) ** BANDS = 3e-6.
BANDS, ROWS = 42, 6
#: What one pass over Arrow data reads: a signature takes room for a permutation of its places for each word.
PROFILE_BYTES = 1 << 19
#: Ids of the documents whose sets are compared are broadcast up to this many bytes, so that no other text is shuffled.
BROADCAST_BYTES = 64 << 20
#: What tells distinct sets apart.
SET = ["d1", "d2", "n_shingles"]
#: Rounds in which the members of a bucket are compared with one centre only, before what is left is compared in full.
STAR_ROUNDS = 2


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each lower-cased text."""
    words = Words(texts)
    h = words.hash
    n = max(0, len(h) - k + 1)
    run = h[:n].copy()
    for i in range(1, k):
        run = mix(run * _GOLD + (h[i : i + n] ^ (h[i : i + n] >> np.uint64(29))) * _M2)
    sets = []
    for t in range(len(texts)):
        r = words.range(t)
        own = h[r]
        if len(own) >= k:
            sets.append(np.unique(run[r.start : r.stop - k + 1]))
        else:
            whole = own[:1]
            for i in range(1, len(own)):  # fewer than k words: one shingle of them all
                whole = mix(whole * _GOLD + own[i : i + 1] + np.uint64(i))
            sets.append(whole)
    return sets


def _digests(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    with np.errstate(over="ignore"):
        d1, d2 = (pa.array(np.fromiter((mix(s * f).sum() if len(s) else 0 for s in sets), np.uint64, len(sets)).view(np.int64)) for f in (np.uint64(1), _GOLD))
    return {"n_shingles": pa.array(np.fromiter((len(s) for s in sets), np.int64, len(sets))), "d1": d1, "d2": d2}


def _profile(k: int, bands: int, rows: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(raw_texts(batch.column(1), lower=True), k)
        keys = band_keys(signatures(sets, bands * rows), bands).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **_digests(sets), "bands": lists})

    return fn


def _set_bytes(k: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(raw_texts(batch.column(1), lower=True), k)
        return pa.RecordBatch.from_pydict({**_digests(sets), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return fn


def _linked(percent: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = np.zeros(batch.num_rows, bool)
        left, right, last, a = batch.column(2), batch.column(3), None, None
        for i, (x, y) in enumerate(zip(left.to_pylist(), right.to_pylist(), strict=True)):
            if x is not last:
                last, a = x, np.frombuffer(x, np.uint64)
            b = np.frombuffer(y, np.uint64)
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
        return pc.filter(batch.select([0, 1]), pa.array(ok))

    return fn


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return map_batches(full, _linked(percent), "a bigint, b bigint")


def _relabel(nodes: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """The n nodes (node, comp) after links (a, b) have joined components."""
    ends = links.join(nodes.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(nodes.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    roots = saved(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()).withColumnRenamed("node", "comp"), "roots", most=n)
    return saved(nodes.join(roots, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")), "labels")


def _differences(percent: int):
    """Of each member and its centre: the shingles that only one of them has, and what a link costs the member.

    Let d be their number and n the size of the member's set. Two members x and y that have `both` of these shingles
    in common are linked if and only if 2 * (100 + percent) * both >= cost x + cost y, where
    cost = (100 + percent) * d - (100 - percent) * n. Near members are linked with the centre itself.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine, centre = (batch.column(c).to_pylist() for c in ("x", "y"))
        apart, cost, near = [], np.empty(len(mine), np.int64), np.empty(len(mine), bool)
        for i, (x, y) in enumerate(zip(mine, centre, strict=True)):
            a, b = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            apart.append(np.setxor1d(a, b, assume_unique=True))
            cost[i] = (100 + percent) * len(apart[-1]) - (100 - percent) * len(a)
            near[i] = cost[i] <= (100 - percent) * len(b)
        sizes = [len(a) for a in apart]
        cols = [np.repeat(c, sizes) for c in (*(batch.column(c).to_numpy() for c in ("c", "node", "comp")), cost, near)]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(apart) if apart else np.zeros(0, np.int64))], names=["c", "node", "comp", "cost", "near", "h"])

    return fn


def _centres(here: DataFrame, weight: DataFrame, t: int = 0) -> DataFrame:
    """The centre c (node, comp) of each bucket of several groups.

    The first centre is the member that meets most others in buckets; later ones are more and more random.
    """
    luck = F.pmod(F.xxhash64("node", F.lit(t)), F.lit(1000)) / 1000
    rank = F.col("weight") * (1 + t * t * luck)
    return here.join(weight, "node").groupBy("key").agg(F.max_by(F.struct("node", "comp"), F.struct(rank, "node")).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "c")


def _star_pairs(here: DataFrame, weight: DataFrame, t: int, n: int) -> DataFrame:
    """Each member of a bucket of several groups, of n buckets, with the bucket's centre, if that is of another group."""
    return here.join(saved(_centres(here, weight, t), "centres", most=n), "key").where("comp <> c.comp").select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b"))


def _rest_pairs(here: DataFrame, weight: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """Every pair of a bucket, of n buckets, from two groups that can be linked, after round 0 has tried all pairs with first centres.

    Members are described by their differences from the bucket's first centre. Two members that are near it are in
    its group, so one of each pair is far, and then the costs of both sum to more than 0: they must share `need`
    differences, (cost x + cost y) / (2 * (100 + percent)) of them. So they share one of the rarest
    u - need + 1 of each, u being those differences of a member that some other group of that centre also has.
    Both ends' costs are bounded by the least ones of the near and of the far members of that centre.
    """
    whole = 2 * (100 + percent)
    family = here.join(saved(_centres(here, weight), "centres", most=n), "key").where("node <> c.node").select("c.node", "node", "comp").toDF("c", "node", "comp").distinct()
    full = family.join(sets.select(F.col("id").alias("node"), F.col("shingles").alias("x")), "node").join(sets.select(F.col("id").alias("c"), F.col("shingles").alias("y")), "c").select("c", "node", "comp", "x", "y")
    apart = saved(map_batches(full, _differences(percent), "c bigint, node bigint, comp bigint, cost bigint, near boolean, h bigint"), "differences")
    common = apart.groupBy("c", "h").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("c", "h", "df")
    common = saved(common, "common", most=apart.count())
    member = apart.join(common, ["c", "h"]).groupBy("c", "node", "comp", "cost", "near").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own"))
    member = saved(member.withColumn("u", F.size("own").cast("long")).withColumn("reach", whole * F.col("u") - F.col("cost")), "members")
    least = member.groupBy("c").agg(F.min(F.expr("if(near, cost, null)")).alias("least_near"), F.min(F.expr("if(near, null, cost)")).alias("least_far"))
    bound = saved(member.join(saved(least, "least"), "c"), "bound")

    def prefixes(rows: DataFrame, other: str, tag: str) -> DataFrame:
        need = F.greatest(F.lit(1), F.ceil((F.col("cost") + F.col(other)) / whole))
        few = rows.where(F.col(other).isNotNull()).withColumn("take", (F.col("u") - need + 1).cast("int")).where("take > 0")
        return few.select("c", F.col("node").alias(f"r{tag}"), F.col("comp").alias(f"g{tag}"), F.col("cost").alias(f"cost{tag}"), F.col("reach").alias(f"reach{tag}"), F.explode(F.expr("transform(slice(own, 1, take), e -> e.h)")).alias("h"))

    far, fits = bound.where("not near"), (F.col("g1") != F.col("g2")) & (F.col("reach1") >= F.col("cost2")) & (F.col("reach2") >= F.col("cost1"))
    mixed = prefixes(far, "least_near", "1").join(prefixes(bound.where("near"), "least_far", "2"), ["c", "h"]).where(fits)
    outer = prefixes(far, "least_far", "1").join(prefixes(far, "least_far", "2"), ["c", "h"]).where(fits & (F.col("r1") < F.col("r2")))
    return mixed.select("r1", "r2").union(outer.select("r1", "r2")).select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b"))


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id of the group).

    Rows that share a doc_id are one document of several texts: what any of them is linked with, the document is
    linked with. A row without text or words is linked with nothing; a null doc_id too (component_id null).
    Equal sets are one node, which goes through banding once. Members of a band bucket
    are first compared with one centre, in star_rounds rounds with other centres and only across groups
    not yet joined; then all pairs of a bucket that are still in different groups are compared, but for those
    whose differences from the bucket's first centre rule a link out. So no candidate pair is lost and pairs inside
    a group are never all formed. star_rounds is 1 at least.
    Extra columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    with clearing(docs.sparkSession):
        member, named = _grouped(docs, shingle, percent, bands, rows, max(1, star_rounds))
    return member.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))


def _grouped(docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, star_rounds: int) -> tuple[DataFrame, DataFrame]:
    """Each row's node and its set's least doc_id; the least doc_id of each linked node's group."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = saved(map_batches(text, _profile(shingle, bands, rows), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>", PROFILE_BYTES), "profiles")
    real = profile.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy(SET).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    classes = saved(classes.withColumn("node", F.monotonically_increasing_id()), "classes", most=profile.count())
    n = classes.count()
    known = classes.select(*SET, "node", "rep")
    member = saved(profile.drop("bands").join(known, SET, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members", keep=True)

    reps = classes.select("node", F.explode("bands").alias("key"))
    shared = saved(reps.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size"), "shared", most=n * bands)
    n_shared = shared.count()
    sized = saved(reps.join(shared, "key").select("key", "node", "size"), "buckets")
    buckets = sized.select("key", "node")
    weight = saved(sized.groupBy("node").agg(F.sum("size").alias("weight")), "weights", most=n)
    several = saved(member.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a < hi").select("doc_id", "a"), "several")
    same = saved(member.join(several, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct(), "same")
    ends = same.select("a").union(same.select("b")).toDF("node").union(weight.select("node")).distinct()
    nodes = saved(ends.select("node", F.col("node").alias("comp")), "labels")
    if not same.isEmpty():
        nodes = _relabel(nodes, same, n)
    wanted = saved(weight.join(known, "node").select(*SET, "node", "rep"), "wanted")
    ids = wanted.select(F.col("rep").alias("doc_id"))
    if wanted.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    found = map_batches(text.join(ids, "doc_id", "left_semi"), _set_bytes(shingle), "n_shingles bigint, d1 bigint, d2 bigint, shingles binary", PROFILE_BYTES)
    sets = saved(found.dropDuplicates(SET).join(wanted, SET).select(F.col("node").alias("id"), "shingles"), "sets")

    tried: DataFrame | None = None
    for t in range(star_rounds + 1):
        mixed = buckets.join(nodes, "node")
        open_keys = saved(mixed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "open-keys", most=n_shared)
        here = saved(mixed.join(open_keys, "key"), "open")
        if here.isEmpty():
            break
        pairs = (_star_pairs(here, weight, t, n_shared) if t < star_rounds else _rest_pairs(here, weight, sets, percent, n_shared)).distinct()
        pairs = saved(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            nodes = _relabel(nodes, saved(_verify(pairs, sets, percent), "links"), n)
            tried = pairs if tried is None else tried.union(pairs)
    top = saved(nodes.join(known.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("component_id")), "components", most=n)
    return member, saved(nodes.join(top, "comp").select("node", "component_id"), "named", keep=True)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows of a group whose doc_id is not the group's least (see near_groups).

    Rows that share a doc_id stay or go as a whole; rows without one, or without words, stay. All columns stay; an empty
    table gives an empty one. The ids that go are written, and broadcast if they are few, so that no text is shuffled then.
    """
    gone = near_groups(docs, shingle, percent).where("doc_id <> component_id").select("doc_id").distinct()
    gone = saved(gone, "gone", keep=True)
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every document by shingles of two words: see near_groups. Rows without a doc_id are kept."""
    return near_groups(documents(spark, sf_dir), shingle=2).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
