"""LM scoring: unigram base and a gated recurrent model, over every token of every document."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import Cuts, table
from .gru import END, UNKNOWN, Gru, score_documents, train
from .quality_classifier import remainder

#: Words of at least 1/HOT_WORDS of all tokens are at most HOT_WORDS: 16 bytes each, 8 MiB, go to all workers.
HOT_WORDS = 1 << 19
CHUNK_TOKENS = 2_000_000
LEAST_WORDS = 1022
#: Documents trained side by side, steps of a truncated back-propagation, learning rate, size of the state.
LANES, WINDOW, RATE, HIDDEN = 160, 20, 0.15, 16


@dataclass
class Lexicon:
    """Counts of frequent words by hash; the model's ids of the most frequent; sums over all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    n_tokens: int
    n_types: int
    ends: int
    known_mass: int

    @property
    def denominator(self) -> float:
        return self.n_tokens + 0.1 * (self.n_types + 1)

    @property
    def open_mass(self) -> float:
        """What the model's UNKNOWN stands for: all words without an id, the unseen one included."""
        n_ids = int((self.ids > UNKNOWN).sum())
        return max(self.n_tokens - self.ends - self.known_mass, 0) + 0.1 * (self.n_types - (self.ends > 0) - n_ids + 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it frequent, its row)."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return self.hashes[at] == h, at


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): every distinct lower-cased word of ``docs`` by its hash, with its count over all whole texts."""

    def run(it):
        for batch in it:
            texts = batch.column(0)
            for i, j in tokens.batches(texts, 16 << 20):
                h, _ = tokens.word_hashes(texts.slice(i, j - i), lower=True)
                u, c = np.unique(h, return_counts=True)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def build_lexicon(vocabulary: DataFrame, ends: int, model_words: int | None = None) -> Lexicon:
    """``model_words``: by default a quarter of the root of the number of tokens, LEAST_WORDS at least."""
    n_words, n_types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_tokens = n_words + ends
    if model_words is None:
        model_words = max(LEAST_WORDS, math.isqrt(n_tokens) // 4)
    hot = vocabulary.where(F.col("c") * HOT_WORDS >= n_tokens).toArrow()
    h, c = hot.column("h").to_numpy().view(np.uint64), hot.column("c").to_numpy()
    order = np.argsort(h)
    h, c = h[order], c[order]
    ids = np.full(len(h), UNKNOWN, np.int32)
    top = np.lexsort((h, -c))[:model_words]
    ids[top] = np.arange(2, 2 + len(top))
    return Lexicon(h, c, ids, int(n_tokens), int(n_types + (ends > 0)), ends, int(c[top].sum()))


def encode(texts: pa.Array, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Model ids of all tokens (END after each text), with each text's first token, and what the base needs."""
    h, first = tokens.word_hashes(texts, lower=True)
    n_docs = len(first) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    seen, at = lexicon.find(h)
    starts = first + np.arange(n_docs + 1)
    ids = np.full(len(h) + n_docs, END, np.int32)
    word_ids = np.where(seen, lexicon.ids[at], UNKNOWN) if len(lexicon.ids) else np.full(len(h), UNKNOWN, np.int32)
    ids[np.arange(len(h)) + doc] = word_ids
    return {"ids": ids, "first": starts, "h": h, "doc": doc, "seen": seen, "at": at, "open": word_ids == UNKNOWN}


def _chunks(it, limit: int = CHUNK_TOKENS):
    """Arrow batches gathered to about ``limit`` tokens (6 bytes taken for one); the last column is the text."""
    held, size = [], 0
    for batch in it:
        for i, j in tokens.batches(batch.column(batch.num_columns - 1)):
            part = batch.slice(i, j - i)
            held.append(part)
            size += part.column(part.num_columns - 1).nbytes
            if size > 6 * limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sum_weights(rows: pa.Table) -> pa.Table:
    """One row of the weights' sums, in the order of the trainers, so that reruns agree to the last bit."""
    rows = rows.sort_by("g")
    w = sum(np.frombuffer(x.as_py(), np.float64) for x in rows.column("w"))
    n = sum(rows.column("n").to_pylist())
    return pa.table({"k": rows.column("k")[:1], "g": [rows.column("g")[0].as_py() % GROUPS], "n": [n], "w": [w.tobytes()]}, schema=_WEIGHTS)


#: Weights travel in slices of 1 MiB, summed first in GROUPS groups of trainers, then over the groups.
SLICE, GROUPS = 1 << 17, 32
_WEIGHTS = pa.schema([("k", pa.int32()), ("g", pa.int32()), ("n", pa.int64()), ("w", pa.binary())])


def fit(docs: DataFrame, lexicon: Lexicon, seed_docs: int = 1500, rounds: int = 4, docs_per_trainer: int = 2000, trainers: int = 4096) -> Gru:
    """Trains on all documents of ``docs`` (doc_id, text), each taken once.

    A first pass over the ``seed_docs`` documents of least hash on one worker gives a common start; then, in each
    of ``rounds`` rounds, a part of the others is spread over trainers (one per ``docs_per_trainer`` documents,
    ``trainers`` at most: a bound on how much weight data is averaged, not on what is read). They train side by
    side from the current weights; the new weights are their mean by tokens, summed in two steps on the executors.
    Documents are placed and ordered by hashes of their content: reruns agree on any layout of the files.
    """
    spark = docs.sparkSession
    n = docs.count()
    order = np.argsort(lexicon.ids[lexicon.ids > UNKNOWN])
    counts = np.concatenate([[lexicon.ends, max(lexicon.n_tokens - lexicon.ends - lexicon.known_mass, 1)], lexicon.counts[lexicon.ids > UNKNOWN][order]])
    # In step with the vocabulary, so that a word's cost grows with the root of it.
    model = Gru.create(counts.astype(float), hidden=HIDDEN, n_classes=max(20, math.isqrt(len(counts)) * 5 // 8))
    if not n:
        return model
    hashed = F.xxhash64(F.lit("lm"), F.col("doc_id").cast("string"), "text")
    picked = docs.select(hashed.alias("h"), (F.pmod(hashed, F.lit(1 << 30)) / float(1 << 30)).alias("p"), "text")
    lex = spark.sparkContext.broadcast(lexicon)

    def turn(part: DataFrame, parts: int, current: Gru) -> Gru:
        base = spark.sparkContext.broadcast(current)

        def run(it):
            from pyspark import TaskContext

            mine, seen = base.value, 0
            for chunk in _chunks(it, 400_000):
                enc = encode(chunk.column(1), lex.value)
                mine, _ = train(mine, enc["ids"], enc["first"], n_lanes=LANES, window=WINDOW, rate=RATE)
                seen += len(enc["ids"])
            if seen:
                w, g = mine.pack().astype(np.float64) * seen, TaskContext.get().partitionId()
                for k, at in enumerate(range(0, len(w), SLICE)):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([g], pa.int32()), pa.array([seen]), pa.array([w[at : at + SLICE].tobytes()], pa.binary())], schema=_WEIGHTS)

        spread = part.repartition(parts, "h").sortWithinPartitions("h", F.length("text"))
        shape = "k int, g int, n long, w binary"
        weights = spread.select("h", "text").mapInArrow(run, shape)
        if parts > GROUPS:
            weights = weights.groupBy("k", F.pmod("g", F.lit(GROUPS)).alias("part")).applyInArrow(_sum_weights, shape)
        got = sorted(weights.groupBy("k").applyInArrow(_sum_weights, shape).collect(), key=lambda r: r["k"])  # the model, once
        base.unpersist()
        if not got:
            return current
        return current.unpack((np.concatenate([np.frombuffer(r["w"], np.float64) for r in got]) / got[0]["n"]).astype(np.float32))

    start = min(1.0, seed_docs / n)
    model = turn(picked.where(F.col("p") < start), 1, model)
    if start == 1:
        return model
    for r in range(rounds):
        lo, hi = (start + (1 - start) * k / rounds for k in (r, r + 1))
        parts = int(max(1, min(trainers, (hi - lo) * n // docs_per_trainer)))
        model = turn(picked.where((F.col("p") >= lo) & (F.col("p") < hi)), parts, model)
    return model


def score_texts(docs: DataFrame, is_training: Column, model_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    base_score: sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over words and one end, with counts of all rows
    that ``is_training`` admits. score: log10 probability by the recurrent model over the ``model_words`` most
    frequent words, END and UNKNOWN; a word without an id costs UNKNOWN's probability times its share of the
    counts of all such words, so every text has a probability. Frequent words' counts go to all workers;
    the others are joined by hash. Null text counts as empty and scores its end alone; a null doc_id is not
    training; repeated rows are scored (and counted) each. Texts of any length are scored whole, their state carried
    from window to window. An empty table gives an empty result; only doc_id and text are read.
    """
    spark = docs.sparkSession
    tokens.small_batches(spark)
    cuts = Cuts(spark, "lm")
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce(is_training, F.lit(False)).alias("fit"), F.coalesce("text", F.lit("")).alias("text"))
    fitted = base.where("fit")
    vocabulary = cuts.cut(word_counts(fitted))
    lexicon = build_lexicon(vocabulary, fitted.count(), model_words)
    model = fit(fitted.select("doc_id", "text"), lexicon)
    shared = spark.sparkContext.broadcast((lexicon, model))

    def run(it):
        lex, gru = shared.value
        log_d, log_open = np.log10(lex.denominator), np.log10(lex.open_mass)
        logs = np.log10(lex.counts + 0.1)
        for chunk in _chunks(it):
            enc = encode(chunk.column(2), lex)
            n_docs = len(enc["first"]) - 1
            doc, seen, at, is_open = enc["doc"], enc["seen"], enc["at"], enc["open"]
            sums = lambda w, rows: np.bincount(doc[rows], weights=w, minlength=n_docs)  # noqa: B023, E731
            n_tokens = np.diff(enc["first"])
            frequent = np.where(seen, logs[at], 0.0) if len(logs) else np.zeros(len(seen))
            partial = sums(frequent, slice(None)) + np.log10(lex.ends + 0.1) - n_tokens * log_d
            both = np.flatnonzero(seen & is_open)
            model_score = score_documents(gru, enc["ids"], enc["first"]) / np.log(10)
            model_score += sums(frequent[both], both) - np.bincount(doc[is_open], minlength=n_docs) * log_open
            known = np.bincount(doc[seen], minlength=n_docs) + (lex.ends > 0)
            # Rare words: distinct per document, for the join.
            rare = np.flatnonzero(~seen)
            h, d = enc["h"][rare], doc[rare]
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(h)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(d[begin], minlength=n_docs))]).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), chunk.column(1), pa.array(n_tokens), pa.array(known), pa.array(partial), pa.array(model_score), listed(h[begin].view(np.int64)), listed(times.astype(np.int32))],
                ["rid", "doc_id", "n_tokens", "known", "base", "model", "rare", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = base.select("rid", "doc_id", "text").mapInArrow(
        run, f"rid long, doc_id {kind}, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"
    )
    scored = cuts.cut(scored)
    rows = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("k"))
    met = rows.join(vocabulary.where(F.col("c") * HOT_WORDS < lexicon.n_tokens), "h", "left")
    c = F.coalesce("c", F.lit(0))
    rest = met.groupBy("rid").agg(F.sum(F.col("k") * F.log10(c + F.lit(0.1))).alias("rest"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("found"))
    rest_of = F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare", "times").join(rest, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest_of).alias("base_score"),
        (F.col("model") + rest_of).alias("score"),
    )


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``, learnt from the rows whose remainder is not 0; edge cases as for ``score_texts``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, remainder(F.col("doc_id"), 10) != 0)
    held_out = F.coalesce(remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
