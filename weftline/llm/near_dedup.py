"""MinHash near-dedup: DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import Cuts, components, join_unique, salted_join, table
from .url_filters import build_bloom, probe_bloom, split_bloom

FIRST_REGION = 2.0**-12
GROWTH = 4


def distinct_elements(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(element, document) of the distinct shingles of at most 1024 documents, ordered by document.

    Elements are the upper 54 bits of the hashes, so that document numbers fit below them in one sort.
    """
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.unique((hashes & ~np.uint64(0x3FF)) | doc)
    doc = (keys & np.uint64(0x3FF)).astype(np.int64)
    order = np.argsort(doc, kind="stable")
    return keys[order] >> np.uint64(10), doc[order]


def _poisson_table(mean: float) -> np.ndarray:
    top = int(mean + 12 * math.sqrt(mean) + 24)
    logs = np.arange(top) * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


def dart_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n_docs, k) signatures: of each coordinate, the earliest dart that hits the document's weighted set.

    An element's plane (weight x rank) is cut into regions that double in weight and grow fourfold in
    rank; a region gets a Poisson number of darts at k per unit of area, each with a hashed weight, rank and
    coordinate, all fixed by the element alone. A dart counts below the element's weight. Regions are taken
    by rising rank until every coordinate of the document is hit, so small and large sets cost about
    k log k darts alike. Two documents agree in a coordinate with the probability of their weighted Jaccard
    similarity. Documents without elements keep the largest value everywhere.
    """
    if weights is None:
        weights = np.ones(len(elements))
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(n_docs * k, none, np.uint64)
    lo, hi, region = 0.0, FIRST_REGION, 0
    live = np.arange(len(elements))
    while len(live):
        e, d, w = elements[live], doc[live], weights[live]
        w_lo, w_hi, octave = 0.0, 1.0, 0
        while len(e):
            cdf = _poisson_table(k * (hi - lo) * (w_hi - w_lo))
            seed = tokens.mix(e * np.uint64(tokens.BASE) + np.uint64(region * 64 + octave + 1))
            count = np.searchsorted(cdf, (seed >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")
            hit = np.repeat(np.arange(len(e)), count)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
            a = tokens.mix(seed[hit] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))
            if octave or (w < 1).any():
                at = w_lo + (w_hi - w_lo) * (tokens.mix(a) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                keep = at < w[hit]
                hit, a = hit[keep], a[keep]
            cell = d[hit] * k + (a & np.uint64(0xFFFF)).astype(np.int64) % k
            # Rank in 40 bits (region first), below it 24 bits that tell darts of equal rank apart.
            rank = (np.uint64(region) << np.uint64(34)) | (a >> np.uint64(30))
            np.minimum.at(sig, cell, (rank << np.uint64(24)) | (tokens.mix(a + np.uint64(1)) >> np.uint64(40)))
            more = w > w_hi
            e, d, w = e[more], d[more], w[more]
            w_lo, w_hi, octave = w_hi, w_hi * 2, octave + 1
        holes = (sig.reshape(n_docs, k) == none).any(1)
        live = live[holes[doc[live]]]
        lo, hi, region = hi, hi * GROWTH, region + 1
    return sig.reshape(n_docs, k)


def sketch(docs: DataFrame, k: int, rows: int, shingle: int, weighted: bool = False) -> DataFrame:
    """rid, doc_id, n (distinct shingles), s1, s2 (a 128-bit name of the shingle set), bands (k / rows hashes)."""
    bands = k // rows

    def run(it):
        for batch in it:
            texts = batch.column(2)
            for i, j in ((a, b) for x, y in tokens.batches(texts, 2 << 20) for a in range(x, y, 1024) for b in [min(a + 1024, y)]):
                h, first = tokens.shingles(*tokens.word_hashes(texts.slice(i, j - i)), shingle)
                m = j - i
                elements, doc = distinct_elements(h, first)
                weights = None
                if weighted:
                    all_docs = np.repeat(np.arange(m, dtype=np.uint64), np.diff(first))
                    keys, counts = np.unique((h & ~np.uint64(0x3FF)) | all_docs, return_counts=True)
                    weights = counts[np.argsort((keys & np.uint64(0x3FF)).astype(np.int64), kind="stable")].astype(float)
                sig = dart_minhash(elements, doc, m, k, weights)
                value = np.zeros((m, bands), np.uint64)
                for r in range(rows):
                    value = tokens.mix(value * np.uint64(tokens.BASE) + sig[:, r::rows][:, :bands])
                value = tokens.mix(value + np.arange(1, bands + 1, dtype=np.uint64))
                n = np.bincount(doc, minlength=m)
                tag = elements if weights is None else elements + weights.astype(np.uint64) * np.uint64(tokens.INVERSE)
                sums = []
                for salt in (1, 2):
                    run_sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix(tag + np.uint64(salt * tokens.BASE & (1 << 64) - 1)), dtype=np.uint64)])
                    end = np.cumsum(n)
                    sums.append((run_sum[end] - run_sum[end - n]).view(np.int64))
                flat = pa.array(value.reshape(-1).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, m), batch.column(1).slice(i, m), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), listed],
                    ["rid", "doc_id", "n", "s1", "s2", "bands"],
                )

    tokens.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("rid", "doc_id", "text").mapInArrow(run, f"rid long, doc_id {kind}, n long, s1 long, s2 long, bands array<long>")


def elements_of(texts: pa.Array, shingle: int, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(element, document) of at most 1024 texts, ordered within one sort: the distinct shingles or, ``weighted``,
    one element per occurrence, so that the similarity of the sets is that of the counts."""
    h, first = tokens.shingles(*tokens.word_hashes(texts), shingle)
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = (h & ~np.uint64(0x3FF)) | doc
    if not weighted:
        return np.unique(keys), np.diff(first)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(new)
    nth = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    again = nth > 0
    keys[again] = (tokens.mix((keys[again] >> np.uint64(10)) * np.uint64(tokens.BASE) + nth[again].astype(np.uint64)) & ~np.uint64(0x3FF)) | (keys[again] & np.uint64(0x3FF))
    keys.sort()
    return keys, np.diff(first)


def overlap_udf(shingle: int, weighted: bool = False):
    """(shared, all) shingles of two texts, distinct ones or with their counts."""

    @F.arrow_udf(T.StructType([T.StructField("shared", T.LongType()), T.StructField("all", T.LongType())]))
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        shared, union = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        step = 64
        for i in range(0, len(a), step):
            sides = [elements_of(x.slice(i, step), shingle, weighted)[0] for x in (a, b)]
            both = np.intersect1d(*sides, assume_unique=True)
            m = min(step, len(a) - i)
            count = lambda keys: np.bincount((keys & np.uint64(0x3FF)).astype(np.int64), minlength=m)  # noqa: B023, E731
            shared[i : i + m] = count(both)
            union[i : i + m] = count(sides[0]) + count(sides[1]) - count(both)
        return pa.StructArray.from_arrays([pa.array(shared), pa.array(union)], ["shared", "all"])

    return overlap


def element_rows(texts: DataFrame, shingle: int, weighted: bool) -> DataFrame:
    """rid, n (elements of the text), e: every element of ``texts`` (rid, text)."""

    def run(it):
        for batch in it:
            for i, j in ((a, b) for x, y in tokens.batches(batch.column(1), 1 << 20) for a in range(x, y, 1024) for b in [min(a + 1024, y)]):
                keys, _ = elements_of(batch.column(1).slice(i, j - i), shingle, weighted)
                doc = (keys & np.uint64(0x3FF)).astype(np.int64)
                n = np.bincount(doc, minlength=j - i)
                rid = batch.column(0).slice(i, j - i).to_numpy()
                yield pa.record_batch([pa.array(rid[doc]), pa.array(n[doc].astype(np.int32)), pa.array((keys >> np.uint64(10)).view(np.int64))], ["rid", "n", "e"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, n int, e long")


def prefix_pairs(rows: DataFrame, roots: DataFrame, similarity: float, cuts: Cuts) -> DataFrame:
    """(a, b) of different roots that may reach ``similarity``, by an exact prefix filter; ``rows``: rid, n, e.

    Elements are ordered from rare to frequent. Sets of similarity s share an element among the first
    n - ceil(2s/(1+s) n) + 1 of the smaller set and the first m - ceil(s m) + 1 of the larger one, so only these are
    joined. What a template gives to all members of a bucket comes last in that order: members that differ in more
    than (1-s)/(1+s) of their elements meet in no prefix and are never paired. Elements of one set alone fill a
    prefix but are not moved: their number tells the ranks of the others.
    """
    known = rows.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    known = cuts.cut(known)
    total = rows.count()
    common = join_unique(rows, known, ["e"], "df", total)
    per = common.groupBy("rid", "n").agg(F.count("*").alias("k"))
    longest = (F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9) + 1).alias("probe")
    shortest = F.col("n") - F.ceil(F.col("n") * F.lit(2 * similarity / (1 + similarity)) - 1e-9) + 1
    # Sets whose own elements fill the longer prefix already meet nothing.
    per = per.select("rid", (F.col("n") - F.col("k")).alias("own"), longest, shortest.alias("index")).where("own < probe")
    ranked = common.join(per, "rid").groupBy("rid", "n", "own", "probe", "index").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    ranked = ranked.select("rid", "n", F.posexplode(F.slice("es", F.lit(1), (F.col("probe") - F.col("own")).cast("int"))).alias("i", "x"), "own", "index")
    prefix = ranked.select("rid", "n", F.col("x.e").alias("e"), (F.col("i") + F.col("own") < F.col("index")).alias("short"))
    prefix = cuts.cut(prefix.join(roots, "rid"))
    # An element that one root alone has in its prefixes pairs nothing.
    mixed = prefix.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("e", "k")
    prefix = cuts.cut(join_unique(prefix, cuts.cut(mixed), ["e"], "k", total).drop("k"))
    small = prefix.where("short").select("e", F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("root").alias("rx"))
    large = prefix.select("e", F.col("rid").alias("y"), F.col("n").alias("ny"), F.col("root").alias("ry"))
    fits = (F.col("rx") != F.col("ry")) & ((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y"))))
    fits &= F.col("nx") >= F.col("ny") * F.lit(similarity) - 1e-9
    return large.join(small, "e").where(fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(texts: DataFrame, members: DataFrame, similarity: float, shingle: int, cuts: Cuts, weighted: bool = False, leads: int = 2) -> DataFrame:
    """Verified links (a, b) that connect what any pair of a bucket's members at ``similarity`` connects.

    ``members``: bucket, rid. First, in ``leads`` rounds, the least open member of each bucket leads and the open ones
    are compared with it; those close to it close. A bucket of one near-duplicate group so takes one comparison
    per member. What is then left, members of one bucket that no link connects, closed ones included, is compared
    where an exact prefix filter cannot tell the two apart (see ``prefix_pairs``): a bucket of members that share
    a template only is not compared pair by pair.
    """
    overlap = overlap_udf(shingle, weighted)
    n_members = members.count()

    def check(pairs: DataFrame) -> DataFrame:
        with_a = salted_join(pairs, texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a", n_members)
        with_b = salted_join(with_a, texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b", n_members)
        checked = with_b.select("a", "b", overlap("text_a", "text_b").alias("o"))
        return cuts.cut(checked.select("a", "b", (F.col("o.shared") >= F.lit(similarity) * F.col("o.all") - 1e-9).alias("close")))

    tried, open_ = None, members
    for k in range(leads):
        leaders = cuts.cut(open_.groupBy("bucket").agg(F.min("rid").alias("a"), F.count("*").alias("k")).where("k > 1"))
        met = cuts.cut(join_unique(open_, leaders, ["bucket"], "k", n_members).where("rid > a").select("bucket", "a", F.col("rid").alias("b")))
        pairs = met.select("a", "b").distinct()
        checked = check(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        tried = checked if tried is None else tried.unionByName(checked)
        if k < leads - 1:
            open_ = cuts.cut(met.join(tried.where("not close"), ["a", "b"]).select("bucket", F.col("b").alias("rid")))
        cuts.drop(met)
    found = tried.where("close").select("a", "b")
    roots = components(found, cuts).withColumnRenamed("node", "rid")
    rooted = cuts.cut(members.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")))
    mixed = cuts.cut(rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi").select("bucket", "k"))
    if mixed.isEmpty():
        return found
    some = cuts.cut(join_unique(rooted, mixed, ["bucket"], "k", n_members).groupBy("rid").agg(F.min("root").alias("root"), F.collect_set("bucket").alias("buckets")))
    rows = cuts.cut(element_rows(texts.join(some.select("rid"), "rid", "left_semi"), shingle, weighted))
    pairs = prefix_pairs(rows, some.select("rid", "root"), similarity, cuts)
    pairs = pairs.join(some.select(F.col("rid").alias("a"), F.col("buckets").alias("in_a")), "a").join(some.select(F.col("rid").alias("b"), F.col("buckets").alias("in_b")), "b")
    pairs = cuts.cut(pairs.where(F.arrays_overlap("in_a", "in_b")).select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    cuts.drop(rows)
    return found if pairs.isEmpty() else found.unionByName(check(pairs).where("close").select("a", "b"))


def near_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 25, rows: int = 5, weighted: bool = True) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, class_id, class_size, n_links, kept.

    Documents are linked when the Jaccard similarity of their word ``shingle``-grams is at least ``similarity``:
    of the counts (the sum of the lesser over the sum of the greater) when ``weighted``, else of the sets; for texts
    that repeat no shingle the two are equal. A class is a connected component and ``class_id`` its least doc_id,
    whose row is kept (null first; of repeated rows, any one). Equal counts are one representative from the
    start, so a large group of copies is never paired. A pair at 0.8 shares a band with probability
    1 - (1 - 0.8^5)^25 = 0.99995, and every candidate is verified on whole texts, however long. ``n_links`` counts the
    verified links of the representative. Null, empty and wordless texts are classes of their own; texts under
    ``shingle`` words are one shingle. An empty table gives an empty result; only doc_id and text are read, so
    further columns, whatever their names, do no harm.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "near")
    # Numbers are drawn once and stored with the text's place in the sketches; texts are read again by them.
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketches = cuts.cut(sketch(base, bands * rows, rows, shingle, weighted))
    reps = sketches.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("rid", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = cuts.cut(reps.select("s1", "s2", "copies", "r.rid", "r.bands"))
    exploded = reps.select("rid", F.explode("bands").alias("bucket"))
    n_rows = reps.count() * bands
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = cuts.cut(join_unique(exploded, shared, ["bucket"], "n", n_rows).drop("n"))
    wanted = cuts.cut(members.select("rid").distinct())
    n_wanted = wanted.count()
    if n_wanted:
        # A bounded filter (4 MiB at most) keeps texts without a candidate out of the shuffle.
        n_blocks = max(1, min(1 << 16, n_wanted * 12 // 512 + 1))
        bloom = build_bloom(wanted.select(F.col("rid").cast("string").alias("key")), n_blocks)
        likely = probe_bloom(base.select("rid", "text", F.col("rid").cast("string").alias("key")), bloom, n_blocks).drop("key")
        texts = cuts.cut(likely.join(wanted, "rid", "left_semi"))
        linked = cuts.cut(links(texts, members, similarity, shingle, cuts, weighted))
        roots = components(linked, cuts)
        degree = linked.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        reps = reps.join(roots.join(degree, "node").withColumnRenamed("node", "rid"), "rid", "left")
        done = [texts, members, wanted]
    else:
        reps = reps.withColumns({"root": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
        done = [members, wanted]
    reps = cuts.cut(reps.select("s1", "s2", "copies", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    for x in done:
        cuts.drop(x)
    total = sketches.count()
    some = join_unique(sketches.where("n > 0").select("rid", "doc_id", "s1", "s2"), reps, ["s1", "s2"], "copies", total).drop("s1", "s2", "copies")
    none = sketches.where("n = 0").select("rid", "doc_id", F.col("rid").alias("root"), F.lit(0).cast("long").alias("n_links"))
    rooted = cuts.cut(some.unionByName(none))
    classes = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("class_size"))
    return join_unique(rooted, classes, ["root"], "class_size", total).select(
        "rid", "doc_id", F.col("keep.doc_id").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("keep.rid")).alias("kept")
    )


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The columns of ``docs``: one row of each class. ``docs`` must be a stored table, since its rows are numbered twice."""
    cuts = Cuts(docs.sparkSession, "gone")
    gone = cuts.cut(near_classes(docs.select("doc_id", "text"), **params).where("not kept").select(F.col("rid").alias("_near_rid")))
    names = docs.columns
    held = docs.select(F.struct(*names).alias("_near_d"), F.monotonically_increasing_id().alias("_near_rid"))
    # Only rows that may go are moved: the filter is of bounded size and the join behind it exact.
    n_blocks = max(1, min(1 << 16, gone.count() * 12 // 512 + 1))
    bloom = build_bloom(gone.select(F.col("_near_rid").cast("string").alias("key")), n_blocks)
    may_go, stays = split_bloom(held.withColumn("key", F.col("_near_rid").cast("string")), bloom, n_blocks)
    out = stays.select("_near_d").unionByName(may_go.join(gone, "_near_rid", "left_anti").select("_near_d"))
    return out.select(*[F.col("_near_d")[c].alias(c) for c in names])


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every row of ``documents``; edge cases as for ``near_classes``. How many links were
    verified on the way to a class depends on the way, so it is left out here."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("rid", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT rid, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM d WHERE len(ws) > 0),
c AS (SELECT rid, g, count(*) AS n FROM sh GROUP BY ALL),
t AS (SELECT rid, sum(n) AS t FROM c GROUP BY 1),
m AS (SELECT a.rid AS x, b.rid AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT x, y FROM m JOIN t a ON a.rid = x JOIN t b ON b.rid = y WHERE m >= 0.8 * (a.t + b.t - m) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x AS rid, min(y) AS root, count(*) AS class_size FROM r GROUP BY x)
SELECT d.doc_id, f.doc_id AS class_id, class_size::BIGINT AS class_size, d.rid = root AS kept FROM d JOIN k USING (rid) JOIN d f ON f.rid = root"""
