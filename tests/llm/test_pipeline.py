"""The pipeline's stages on the driver's small table, each held against brute force on its own input."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm.common import Cuts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_stages(spark, sf):
    cuts = Cuts(spark, "pipeline-test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cuts.cut(stage(spark, tables[-1], sf)))
    raw, good, lined, near, mixed, packed = [t.collect() for t in tables]
    assert all(t.columns == columns for t in tables[:-1])

    kept = {r["doc_id"] for r in good}
    judged = [d for d in labels if d in {r["doc_id"] for r in raw}]
    assert sum((d in kept) == bool(labels[d]) for d in judged) >= 0.9 * len(judged)

    seen, want = set(), {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        with_word = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for i, j in zip(with_word, with_word[1:]):
            pair = (lines[i], lines[j])
            if pair in seen:
                gone |= {i, j}
            seen.add(pair)
        left = [x for i, x in enumerate(lines) if i not in gone]
        if not gone or any(WORD.search(x) for x in left):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in lined} == want

    sets = {r["doc_id"]: shingles(r["text"]) for r in lined}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in near} == {find(d) for d in sets}

    size, taken = Counter(), Counter()
    for r in near:
        size[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(taken[s] <= 2 * n for s, n in size.items())
    assert abs(sum(taken.values()) - min(1.5, 2) * sum(size.values())) <= 64 * 4 * len(size)

    bins = defaultdict(int)
    for r in packed:
        bins[r["bin_id"]] += r["n_tokens"]
        assert bins[r["bin_id"]] <= r["bin_size"]
    assert sum(bins.values()) == sum(taken.values())


def test_edge_rows_pass_every_stage(spark, sf, tmp_path):
    # Null and empty texts, nulls elsewhere, repeated rows, one very long text, columns of any name; and an empty table.
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(None, "some words here", None, None, None), (900, None, "en", "src0", None), (901, "", "en", None, 0), (902, long, "en", "src0", len(long)), (903, " \n ", None, "src0", 3)]
    more = spark.createDataFrame(odd + odd[:1], "doc_id long, text string, lang string, source string, n_chars long")
    both = docs.unionByName(more).withColumns({"_rid": F.lit("x"), "_mix_h": F.lit(1)})
    cuts = Cuts(spark, "pipeline-edges")
    for start in (both, both.limit(0)):
        table = cuts.cut(start)
        rows = table.count()
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            table = cuts.cut(stage(spark, table, sf))
            assert name == "best-fit packing" or table.columns == columns
            assert rows or not table.count(), name


def test_stages_keep_null_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, "alpha beta gamma"), (4, "alpha beta gamma"), (None, None)]
    docs = Cuts(spark, "t").cut(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    ids = lambda stage: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in stage(spark, docs, "").collect())
    assert ids(corpus_pipeline.lines) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 4)]
    assert ids(corpus_pipeline.near) == [(False, 0), (True, 1), (True, 2), (True, 3)]
