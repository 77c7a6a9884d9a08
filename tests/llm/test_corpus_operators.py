"""Each corpus operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows,
extra columns whose names clash with internal ones, and empty tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, gru, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, substring_dedup, tokens, url_filters
from weftline.llm.common import Cuts, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, n int, size string, words string, key int, block string, score string, name string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus() -> list[tuple]:
    base = [prose(i, 60 + 7 * i) for i in range(24)]
    texts = list(base)
    texts += [base[0], base[0], base[1]]
    near = base[2].split()
    near[30] = "changed"
    texts.append(" ".join(near))
    passage = prose(99, 70)
    texts += [prose(200 + i, 40) + " " + passage + " " + prose(300 + i, 30) for i in range(3)]
    texts += ["", None, None, "one", "one two", " \t\n ", "a\nb\na\n\nb c\n", "x y z " * 40]
    texts.append(prose(7, 9000))
    texts += ["line one here\nline two here\nown " + str(i) for i in range(4)]
    rows = [(i, t, "en", ("s0", "s1", "s2", None)[min(i % 5, 3)], None if t is None else len(t), "x", 1, "x", "x", 1, "x", "x", "x") for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    rows.append((None, base[5], None, None, None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def ws(t):
    return WORD.findall(t or "")


def test_tokens_match_the_regex():
    texts = [r[1] for r in corpus()]
    h, first = tokens.word_hashes(pa.array(texts))
    split = [ws(t) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in split]
    assert len(set(h.tolist())) == len({x for w in split for x in w})
    lowered, _ = tokens.word_hashes(pa.array(["ÀB Ab"]), lower=True)
    assert lowered[1] == tokens.word_hashes(pa.array(["ab"]))[0][0]
    s, sf = tokens.shingles(h, first, 5)
    assert np.diff(sf).tolist() == [max(len(w) - 4, 1) if w else 0 for w in split]


def test_blocks_do_not_change_hashes(monkeypatch):
    text = pa.array([prose(1, 500)])
    whole = tokens.word_hashes(text)[0]
    monkeypatch.setattr(tokens, "BLOCK", 50)
    tokens._tables.clear()
    assert (tokens.word_hashes(text)[0] == whole).all()
    tokens._tables.clear()


def test_quality_rules(docs, empty):
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        t, w = r["text"] or "", ws(r["text"])
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if ws(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(empty).count() == 0


def test_exact_dedup(docs, empty):
    for block, hot in ((4096, 1000), (16, 2)):
        got = exact_dedup.exact_groups(docs, block, hot).collect()
        groups = defaultdict(list)
        for i, t, *_ in corpus():
            groups[t or ""].append(i)
        size = {hashlib.sha256(t.encode()).hexdigest(): (len(v), max((x for x in v if x is not None), default=None)) for t, v in groups.items()}
        assert len(got) == len(corpus())
        assert all((r["group_size"], r["keep_id"]) == size[r["text_sha256"]] for r in got)
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(dict.fromkeys(size, 1))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_url_filters(spark):
    urls = [None, "", "nourl", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/1", "http://x.net/es/1", "http://net/fr/", "http://com", "ftp://spam-farm.example.org?x", "http://notexample.com/en/", "http://q.org/en/", "http://b.net/es", "http://adult-x.example.net", "http://spam-farm.example.org:8080/x", "http://user:pw@spam-farm.example.org/", "https://www.spam-farm.example.org./y?z", "http://sub.spam-farm.example.org/", "http://spam-farm.example.org.evil/", "http://" + "a." * 3000 + "com/" + "x" * 9000]
    rows = [(i, u, "h", "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    rules = spark.createDataFrame(list(url_filters.DEFAULT_RULES), "host string, path string, verdict string")
    listed = spark.createDataFrame([(u,) for u in (*url_filters.DEFAULT_LISTED, None)], "url string")
    got = {r["page_id"]: r for r in url_filters.filter_urls(pages, rules, listed).collect()}
    for i, u in enumerate(urls):
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0] if u and "://" in u else ""
        host, path = (rest.split("/", 1) + [None])[:2]
        path = "" if path is None else "/" + path
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        name = re.sub(r"^www\.|\.$", "", re.sub(r":\d*$", "", host.rsplit("@", 1)[-1]))
        bad = any(name == x[:-1] for x in url_filters.DEFAULT_LISTED)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (best[1] if best else None)
        assert got[i]["verdict"] == (best[2] if best else "block" if bad else "allow"), u
    assert url_filters.filter_urls(pages, rules.limit(0), listed.limit(0)).where("verdict <> 'allow'").count() == 0
    assert url_filters.filter_urls(pages.limit(0), rules, listed).count() == 0


def test_mixing(docs, empty, spark):
    got = mixing.mix_counts(docs, block_tokens=4).collect()
    assert len(got) == len(corpus())
    size = defaultdict(int)
    for _, t, _, s, *_ in corpus():
        size[s] += len(ws(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if weight[s] * level > 2 * size[s]}
        if not capped:
            target |= {s: weight[s] * level for s in free}
            break
        for s in capped:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= capped
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 4 * 8 for s in order)
    again = mixing.mix_counts(docs, block_tokens=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix_documents(docs, block_tokens=4)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r["source"]] += len(ws(r["text"]))
    assert words == taken
    assert mixing.mix_counts(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_golden_points(spark):
    got = [r["x"] for r in spark.range(1, 2000).select(mixing._golden_point(F.col("id")).alias("x")).collect()]
    want = [((i * 11400714819323198485) % (1 << 64) >> 11) / (1 << 53) for i in range(1, 2000)]
    assert got == want


def test_packing(docs, empty):
    for shard in (10, 20_000):
        rows = packing.pack_documents(docs, shard_pieces=shard).collect()
        bins = defaultdict(list)
        words = Counter()
        for r in rows:
            bins[r["bin_id"]].append(r)
            words[r["row_key"], r["copy"]] += r["n_tokens"]
            assert 0 < r["n_tokens"] <= r["bin_size"]
        assert sum(words.values()) == sum(len(ws(t)) for _, t, *_ in corpus())
        for ps in bins.values():
            ps.sort(key=lambda r: r["bin_offset"])
            end = 0
            for p in ps:
                assert p["bin_offset"] == end
                end += p["n_tokens"]
            assert end == ps[0]["bin_tokens"] <= ps[0]["bin_size"] == min(c for c in packing.CAPACITIES if c >= end)
    seqs = packing.assemble(docs, packing.pack_documents(docs)).collect()
    assert sum(len(ws(s["text"].replace("<|end|>", ""))) for s in seqs) == sum(len(ws(t)) for _, t, *_ in corpus())
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_is_tightest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.integers(1, 60, 80))[::-1]
        at, _, used = packing.best_fit(lengths, (16, 32, 64), 64)
        room, size = [], []
        for n, b in zip(lengths.tolist(), at.tolist(), strict=True):
            fits = [r for r in room if r >= n]
            if fits:
                assert room[b] == min(fits)
            else:
                assert b == len(room)
                room.append(64)
                size.append(64)
            room[b] -= n
        costs = {}
        for opening in (16, 32, 64):
            _, _, filled = packing.best_fit(lengths, (16, 32, 64), opening)
            costs[opening] = sum(packing.bin_cost(min(c for c in (16, 32, 64) if c >= f)) for f in filled)
        bins, _, sizes, _ = packing.pack_lengths(lengths, (16, 32, 64))
        total = sum(packing.bin_cost(int(sizes[bins == b][0])) for b in set(bins.tolist()))
        assert total <= min(costs.values()) + 1e-6


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_line_dedup(docs, empty, spark, min_lines):
    got = line_dedup.find_repeats(docs, min_lines)
    ids = {r["rid"]: r["doc_id"] for r in got["docs"].select("rid", "doc_id").collect()}
    texts = {r["rid"]: r["text"] for r in docs.select(F.monotonically_increasing_id().alias("rid"), "text").collect()}
    order = sorted(ids, key=lambda k: (ids[k] is not None, ids[k] or 0, k))
    seen, gone = {}, set()
    seq = {k: [(i, x) for i, x in enumerate((texts[k] or "").split("\n")) if ws(x)] for k in order}
    for k in order:
        s = seq[k]
        for j in range(len(s) - min_lines + 1):
            run = tuple(x for _, x in s[j : j + min_lines])
            if run in seen:
                gone |= {(k, i) for i, _ in s[j : j + min_lines]}
            else:
                seen[run] = (k, j)
    assert {(r["rid"], r["i"]) for r in got["removed"].collect()} == gone
    # Each run is the exact longest common prefix of its start and the place it copies; together they are what goes.
    covered = set()
    for r in got["runs"].collect():
        a, b = [x for _, x in seq[r["rid"]]][r["start"] :], [x for _, x in seq[r["from_rid"]]][r["from_start"] :]
        assert r["n_lines"] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) >= min_lines
        covered |= {(r["rid"], seq[r["rid"]][r["start"] + k][0]) for k in range(r["n_lines"])}
    assert covered == gone
    out = line_dedup.dedup_lines(docs, min_lines)
    assert out.columns == docs.columns
    want = Counter()
    for k in order:
        lines = (texts[k] or "").split("\n")
        left = [x for i, x in enumerate(lines) if (k, i) not in gone]
        touched = len(left) < len(lines)
        if not touched or any(ws(x) for x in left):
            want[(ids[k], "\n".join(left) if touched else texts[k])] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()) == want
    assert line_dedup.dedup_lines(empty, min_lines).count() == 0


def shingle_set(t, k=5):
    w = ws(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_dedup(docs, empty):
    got = near_dedup.near_classes(docs).collect()
    rows = corpus()
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(rows[i][0])
    want = Counter((min(v, key=lambda x: (x is not None, x)), len(v)) for v in classes.values() for _ in v)
    assert Counter((r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(classes)
    assert near_dedup.near_classes(empty).count() == 0


def test_dart_minhash_estimates_jaccard():
    rng = np.random.default_rng(5)
    k = 256
    pool = tokens.mix(np.arange(1, 4001, dtype=np.uint64)) >> np.uint64(10)
    for n, shared in ((5, 3), (50, 40), (700, 350)):
        a, b = pool[:n], np.concatenate([pool[:shared], pool[2000 : 2000 + n - shared]])
        sig = near_dedup.dart_minhash(np.concatenate([a, b]), np.repeat([0, 1], n), 2, k)
        truth = shared / (2 * n - shared)
        assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / k) + 0.02
    w = rng.uniform(0.1, 3, 60)
    v = np.where(rng.random(60) < 0.5, w, w * 0.5)
    sig = near_dedup.dart_minhash(np.concatenate([pool[:60]] * 2), np.repeat([0, 1], 60), 2, 1024, np.concatenate([w, v]))
    truth = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    assert abs((sig[0] == sig[1]).mean() - truth) < 4 * math.sqrt(truth * (1 - truth) / 1024) + 0.01


def test_links_join_every_pair_of_a_bucket(spark):
    # A chain in one bucket: 0 is close to 1, 1 to 2, 2 to 3; no leader is close to all.
    words = prose(1, 160).split()
    texts = [" ".join(words[i : i + 100]) for i in (0, 9, 18, 27)] + [prose(2, 100)]
    t = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    members = spark.createDataFrame([(1, i) for i in range(5)], "bucket long, rid long")
    cuts = Cuts(spark, "test")
    found = near_dedup.links(t, members, 0.8, 5, cuts)
    roots = {r["node"]: r["root"] for r in components(found, cuts).collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 3: 0}


def test_links_do_not_depend_on_row_order(spark):
    words = prose(1, 160).split()
    texts = [" ".join(words[i : i + 100]) for i in (0, 9, 18, 27)] + [prose(2, 100)]
    rows = [(b, 5 * b + k, texts[j]) for b, order in enumerate(itertools.permutations(range(5))) for k, j in enumerate(order)]
    t = spark.createDataFrame(rows, "bucket long, rid long, text string")
    cuts = Cuts(spark, "test")
    found = near_dedup.links(t.select("rid", "text"), t.select("bucket", "rid"), 0.8, 5, cuts)
    roots = {r["node"]: r["root"] for r in components(found, cuts).collect()}
    chains = defaultdict(list)
    for b, rid, text in rows:
        if text != texts[4]:
            chains[b].append(rid)
    assert roots == {rid: min(chain) for chain in chains.values() for rid in chain}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100, i) for i in range(101, 160)]
    cuts = Cuts(spark, "test")
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), cuts).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in {n for a, b in edges if a != b for n in (a, b)}}


def test_compact_windows_cover_every_run_once():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n = [int(x) for x in rng.integers(0, 30, rng.integers(1, 4))]
        first, t = np.concatenate([[0], np.cumsum(n)]), int(rng.integers(2, 9))
        v = rng.integers(1, rng.choice([4, 1000]), first[-1]).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in substring_dedup.compact_windows(v, first, t)), strict=True))
        want = set()
        for k in range(len(n)):
            s = v[first[k] : first[k + 1]].tolist()
            for i in range(len(s)):
                a = b = i
                while a and s[a - 1] > s[i]:
                    a -= 1
                while b + 1 < len(s) and s[b + 1] >= s[i]:
                    b += 1
                if b - a + 1 >= t:
                    want.add((k, a, i, b))
        assert got == want


def test_substring_dedup(docs, empty):
    rows = substring_dedup.find_passages(docs.where("doc_id is not null")).collect()
    by_id = {}
    for i, t, *_ in corpus():
        if i is not None:
            by_id.setdefault(i, ws(t))
    covered = defaultdict(set)
    for r in rows:
        covered[r["doc_id"]] |= set(range(r["start"], r["start"] + r["n_words"]))
        a = by_id[r["doc_id"]][r["start"] : r["start"] + r["n_words"]]
        b = by_id[r["source_id"]][r["source_start"] : r["source_start"] + r["source_words"]]
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert len(x & y) >= 0.8 * len(x | y)
    shared = {tuple(w[i : i + 50]): [] for w in by_id.values() for i in range(len(w) - 49)}
    for d, w in by_id.items():
        for i in range(len(w) - 49):
            shared[tuple(w[i : i + 50])].append((d, i))
    for hits in shared.values():
        if len({d for d, _ in hits}) > 1:
            assert sum(not set(range(i, i + 50)) <= covered[d] for d, i in hits) <= len([d for d, _ in hits if d == hits[0][0]]) or len(hits) > 2
            assert sum(set(range(i, i + 50)) <= covered[d] for d, i in hits) >= 1
    assert substring_dedup.find_passages(empty).count() == 0


def test_a_partial_leader_hides_no_passage(spark):
    # A holds the first 49 words of what B and C share, in 40 families: B leads none of the windows inside A.
    rows = []
    for k in range(40):
        passage = prose(5000 + k, 60)
        rows.append((3 * k, prose(6000 + k, 60) + " " + " ".join(passage.split()[:49]) + " " + prose(7000 + k, 60)))
        rows += [(3 * k + j, prose(8000 + 2 * k + j, 40) + " " + passage + " " + prose(9000 + 2 * k + j, 40)) for j in (1, 2)]
    t = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {(r["doc_id"], r["source_id"], r["start"], r["n_words"]) for r in substring_dedup.find_passages(t).collect()}
    assert found == {(3 * k + 2, 3 * k + 1, 40, 60) for k in range(40)}


def test_lm_base_is_exact_and_the_model_is_a_probability(docs, empty):
    got = lm_scoring.score_texts(docs, F.col("doc_id") % 2 == 0).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tok = lambda t: ws((t or "").translate(low)) + [0]
    c = Counter()
    for i, t, *_ in corpus():
        if i is not None and i % 2 == 0:
            c.update(tok(t))
    n, d = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    want = Counter()
    for i, t, *_ in corpus():
        w = tok(t)
        want[(i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / d) for x in w), 4))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm_scoring.score_texts(empty, F.lit(True)).count() == 0


def test_lm_trains_on_every_document(spark, tmp_path):
    # Of 2000 documents the last quarter by hash differs in its texts, not in their lengths.
    point = F.pmod(F.xxhash64(F.lit("lm"), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    for name, last in (("one", "aaa bbb ccc"), ("two", "ccc aaa bbb")):
        text = F.when(point < 0.8, "bbb aaa ccc").otherwise(last)
        spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(str(tmp_path / name))
    one, two = (spark.read.parquet(str(tmp_path / name)) for name in ("one", "two"))
    lexicon = lm_scoring.build_lexicon(lm_scoring.word_counts(one), 2000, 10)
    models = [lm_scoring.fit(x, lexicon).pack() for x in (one, two)]
    assert not np.array_equal(*models)


def test_gru_sums_to_one_carries_state_and_learns():
    rng = np.random.default_rng(0)
    counts = np.array([50.0, 80, 60, 40, 30, 20, 10, 5])
    m = gru.Gru.create(counts, hidden=8, n_classes=4)
    h = rng.normal(size=(3, 8)).astype(np.float32)
    total = sum(np.exp(m.log_probs(h, np.full(3, w))) for w in range(8))
    assert np.allclose(total, 1, atol=1e-5)
    ids = np.concatenate([np.append(np.tile([2, 3, 4], 60), gru.END) for _ in range(40)])
    first = np.arange(41) * 181
    whole = gru.score_documents(m, ids, first, n_lanes=4, window=64)
    small = gru.score_documents(m, ids, first, n_lanes=40, window=7)
    assert np.allclose(whole, small, rtol=1e-4)
    trained, _ = gru.train(m, ids, first, n_lanes=8, window=12)
    assert gru.score_documents(trained, ids, first).sum() > 0.5 * whole.sum()
    assert np.allclose(trained.unpack(trained.pack()).weights["h"], trained.weights["h"])


def test_gru_gradient(monkeypatch):
    rng = np.random.default_rng(1)
    m = gru.Gru.create(np.array([5.0, 4, 3, 3, 2, 2]), hidden=5, n_classes=4)
    m.weights = {k: w.astype(np.float64) + rng.normal(0, 0.3, w.shape) for k, w in m.weights.items()}
    ids, first = np.array([2, 3, 4, 5, 1, 0]), np.array([0, 6])
    loss = lambda: -gru.score_documents(m, ids, first).sum()
    for name in ("x", "h", "b", "co", "o", "ob"):
        w = m.weights[name]
        at = tuple(int(s) // 2 for s in w.shape)
        w[at] += 1e-3
        up = loss()
        w[at] -= 2e-3
        down = loss()
        w[at] += 1e-3
        slope = (up - down) / 2e-3
        before = w[at]
        out, _ = gru.train(m, ids, first, n_lanes=1, window=6, rate=1e-6)
        moved = before - out.weights[name][at]
        if abs(slope) > 1e-2:
            assert np.sign(moved) == np.sign(slope), name


def test_pu_classifier(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = quality_classifier.train(docs, labels, quality_classifier.remainder(F.col("doc_id"), 3) != 1)
    held = quality_classifier.score_quality(docs, model).join(labels, "doc_id").where(quality_classifier.remainder(F.col("doc_id"), 3) == 1)
    r = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert r["acc"] > 0.95 and r["n"] > 50
    assert quality_classifier.remainder(F.lit(12), 3) is not None
    assert spark.range(1).select(quality_classifier.remainder(F.lit(12345), 10)).first()[0] == zlib.crc32(b"12345") % 10


def test_pu_classifier_edges(docs, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels, F.lit(True))
    out = quality_classifier.score_quality(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score_quality(empty, model).count() == 0
    assert quality_classifier.train(empty, labels, F.lit(True)).prior == 0.5


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p, neg = rng.normal(2, 1, 3000), rng.normal(-2, 1, 3000)
    for prior in (0.3, 0.8):
        u = np.concatenate([rng.normal(2, 1, int(4000 * prior)), neg[: int(4000 * (1 - prior))]])
        assert abs(quality_classifier.estimate_prior(p, u) - prior) < 0.08


def test_listed_urls_match_exactly(spark):
    urls = ["http://a.org/x", "https://www.A.org:443/x?q", "http://a.org/xyz", "http://sub.a.org/x", "http://a.org/x/", "http://a.org", "http://b.org", "http://b.org/any", "http://u@b.org:1/", "http://notb.org/", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    listed = spark.createDataFrame([("a.org/x",), ("https://b.org",), ("",), (None,)], "url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages, none, listed).collect()}
    assert [u for i, u in enumerate(urls) if got[i] == "block"] == ["http://a.org/x", "https://www.A.org:443/x?q", "http://b.org", "http://b.org/any", "http://u@b.org:1/"]
    assert url_filters.filter_urls(pages.limit(0), none, listed).count() == 0


def test_template_bucket_is_not_compared_pair_by_pair(spark):
    # One bucket: 60 pages of one template, over a third of each its own; two near copies and a late pair among them.
    template, own = prose(1, 130).split(), [prose(10 + k, 70).split() for k in range(60)]
    texts = [" ".join(template + own[k]) for k in range(60)]
    texts += [" ".join(template + own[7][:-3] + ["changed"] * 3), " ".join(template + own[59] + ["more"])]
    t = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    members = t.select(F.lit(1).cast("long").alias("bucket"), "rid")
    cuts = Cuts(spark, "test")
    compared = []
    cut = Cuts.cut

    class Counting(Cuts):
        def cut(self, df):
            out = cut(self, df)
            if out.columns == ["a", "b", "close"]:
                compared.append(out.count())
            return out

    for weighted in (False, True):
        compared.clear()
        found = near_dedup.links(t, members, 0.8, 5, Counting(spark, "test"), weighted)
        assert {(r["a"], r["b"]) for r in found.collect()} == {(7, 60), (59, 61)}
        n = len(texts)
        assert sum(compared) <= 2 * n + 4 < n * (n - 1) // 2
    assert components(found, cuts).count() == 4


@pytest.mark.parametrize("weighted", [False, True])
def test_prefix_pairs_lose_no_link(spark, weighted):
    rng = random.Random(11)
    base = [prose(k, 60).split() for k in range(3)]
    texts = []
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = rng.choices(base[0], k=rng.randint(0, 2))
        texts.append(" ".join(w * rng.choice((1, 1, 2))))
    t = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    rows = near_dedup.element_rows(t, 3, weighted)
    roots = t.select("rid", F.col("rid").alias("root"))
    got = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(rows, roots, 0.7, Cuts(spark, "test")).collect()}
    counts = [Counter(tuple(w[i : i + 3]) for w in [x.split()] for i in range(len(w) - 2)) for x in texts]
    if not weighted:
        counts = [Counter(dict.fromkeys(c, 1)) for c in counts]
    like = {(i, j) for j in range(len(texts)) for i in range(j) if sum((counts[i] & counts[j]).values()) >= 0.7 * sum((counts[i] | counts[j]).values())}
    assert like and like <= got and len(got) < len(texts) * (len(texts) - 1) // 2


def test_results_do_not_depend_on_the_layout(spark, tmp_path):
    rows = [(i % 90 if i % 13 else None, prose(i % 40, 1 + i * 7 % 90) if i % 11 else None, ("a", "b", None)[i % 3]) for i in range(240)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id int, text string, source string")
    df.repartition(2).write.parquet(str(tmp_path / "one"))
    df.orderBy(F.desc("text")).repartition(9).write.parquet(str(tmp_path / "two"))
    one, two = (spark.read.parquet(str(tmp_path / x)) for x in ("one", "two"))
    for f in (lambda d: mixing.mix_counts(d, block_tokens=8), lambda d: mixing.mix_documents(d, block_tokens=8), packing.pack_documents, lambda d: packing.pack_documents(d.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), shard_pieces=50)):
        a, b = (Counter(map(tuple, f(d).collect())) for d in (one, two))
        assert a == b and a
    drawn = mixing.draw_order(one, block_tokens=8)
    assert drawn.groupBy("slot").agg(F.sum("words").alias("w")).where("w > 8").isEmpty()
    taken = {r[0]: r[1] for r in mixing.mix_counts(one, block_tokens=8).groupBy("source").agg(F.sum("taken")).collect()}
    assert {r[0]: r[1] for r in drawn.groupBy("source").agg(F.sum("words")).collect()} == {k: v for k, v in taken.items() if v}


def test_clashing_columns_pass_through(spark):
    names = ["_rid", "_gone", "_ls", "_left", "_d", "_t", "_mix_d", "_mix_h", "_mix_b", "_near_rid", "_near_d", "key", "block", "hit", "size", "target", "takes", "b", "e", "c"]
    rows = [(i, f"one {i % 4}\ntwo {i % 4}\nthree {i}", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = Cuts(spark, "test").cut(spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)))
    for f in (line_dedup.dedup_lines, mixing.mix_documents, near_dedup.keep_one):
        out = f(df)
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)
    odd = df.withColumns({"_w": F.lit("w"), "_l": F.lit("l"), "_w_": F.lit("w")})
    assert {(r["_w"], r["_l"], r["_w_"]) for r in quality_rules.apply_rules(odd).collect()} == {("w", "l", "w")}


def test_adaptive_opening_beats_single_sizes():
    # Long and short pieces: a size for the one wastes or splits the other.
    lengths = np.array([60] * 20 + [30] * 20 + [7] * 30)
    cost = lambda c: 3 + c + c * c / 200
    at, _, used = packing.best_fit(lengths, (8, 16, 32, 64), None, cost)
    assert sum(used) == lengths.sum() and len(at) == len(lengths)
    least = lambda filled: sum(cost(min(c for c in (8, 16, 32, 64) if c >= f)) for f in filled)
    assert least(used) <= min(least(packing.best_fit(lengths, (8, 16, 32, 64), c, cost)[2]) for c in (8, 16, 32, 64))


def test_quality_risk_is_the_non_negative_one():
    # The fitted model lowers the risk as the formula gives it, evaluated here row by row.
    rng = np.random.default_rng(4)
    d = quality_classifier.DENSE + quality_classifier.HASHED
    good, bad = rng.normal(0.4, 1, (400, d)).astype(np.float32), rng.normal(-0.4, 1, (400, d)).astype(np.float32)
    p, u, prior = good[:150], np.vstack([good[150:], bad]), 0.38

    def risk(model):
        f = lambda x: [float(z) for z in model.logits(x)]
        loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
        mean = lambda v: sum(v) / len(v)
        return prior * mean([loss(z) for z in f(p)]) + max(0.0, mean([loss(-z) for z in f(u)]) - prior * mean([loss(-z) for z in f(p)]))

    start, end = (quality_classifier.fit_pu(p, u, prior, epochs=k) for k in (1, 30))
    assert risk(end) < 0.6 * risk(start)
    right = np.concatenate([end.scores(good[150:]) >= 0.5, end.scores(bad) < 0.5])
    assert right.mean() > 0.95


def test_quality_features_by_hand():
    texts = ["Buy Buy now!! 50% $off$\n# # x", "", None, "ärger über alles alles alles"]
    got = quality_classifier.features(pa.array(texts))
    for row, t in zip(got, texts, strict=True):
        w, raw = ws(t), (t or "").encode()
        n = max(len(w), 1)
        assert math.isclose(row[0], math.log1p(len(w)), rel_tol=1e-5)
        assert math.isclose(row[1], sum(len(x.encode()) for x in w) / n / 10, rel_tol=1e-5)
        assert math.isclose(row[3], len(set(w)) / n, rel_tol=1e-5) and math.isclose(row[5], sum(a == b for a, b in zip(w, w[1:])) / n, rel_tol=1e-5, abs_tol=1e-7)
        assert math.isclose(row[6], sum(c in b"#*$%&<>" for c in raw) / max(len(raw), 1), rel_tol=1e-5, abs_tol=1e-7)
        assert math.isclose(row[19], sum(len(x.encode()) == 1 for x in w) / n, rel_tol=1e-5, abs_tol=1e-7)
        assert math.isclose(float((row[quality_classifier.DENSE :] ** 2).sum()), len(w) / n, rel_tol=1e-4)


def test_fragments_do_not_hide_a_passage(spark):
    # Six documents hold 49 words of a passage each, two later ones all 60.
    words = prose(5, 60).split()
    rows = [(i, prose(100 + i, 40) + " " + " ".join(words[a : a + 49]) + " " + prose(200 + i, 40)) for i, a in enumerate((0, 2, 4, 6, 8, 11))]
    rows += [(10 + i, prose(300 + i, 30) + " " + " ".join(words) + " " + prose(400 + i, 30)) for i in range(2)]
    got = substring_dedup.find_passages(spark.createDataFrame(rows + [(None, None), (0, "")], "doc_id long, text string")).collect()
    assert any((r["doc_id"], r["source_id"]) == (11, 10) and r["start"] <= 30 and r["start"] + r["n_words"] >= 90 for r in got)


def test_gru_gradients_are_those_of_the_loss():
    # Adagrad's first step moves each weight against its gradient: its sign is that of the loss's change, by differences.
    rng = np.random.default_rng(2)
    m = gru.Gru.create(np.array([9.0, 7, 6, 5, 4, 3, 3, 2]), hidden=4, n_classes=4)
    m.weights = {n: (w + rng.normal(0, 0.3, w.shape)).astype(np.float32) for n, w in m.weights.items()}
    ids = np.array([2, 3, 4, 2, 0, 5, 6, 7, 2, 3, 0, 4, 4, 0], np.int32)
    first = np.array([0, 5, 11, 14])
    moved, loss = gru.train(m, ids, first, n_lanes=2, window=32, rate=1e-3)

    def total(flat):
        return -gru.score_documents(m.unpack(flat), ids, first).sum() / len(ids)

    assert math.isclose(loss, total(m.pack()), rel_tol=1e-5)
    flat, step = m.pack().astype(np.float64), moved.pack().astype(np.float64) - m.pack()
    checked = 0
    for k in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[k] += 2e-2
        down[k] -= 2e-2
        slope = (total(up.astype(np.float32)) - total(down.astype(np.float32))) / 4e-2
        if abs(slope) > 5e-3:
            assert step[k] * slope < 0, k
            checked += 1
    assert checked > 40


def test_gru_scores_by_hand():
    # A forward pass written out word by word.
    rng = np.random.default_rng(6)
    m = gru.Gru.create(np.array([5.0, 4, 3, 2, 2, 1]), hidden=3, n_classes=4)
    m.weights = {n: (w + rng.normal(0, 0.4, w.shape)).astype(np.float32) for n, w in m.weights.items()}
    w, docs = {n: x.astype(float) for n, x in m.weights.items()}, [[2, 3, 5, 0], [0], [4, 4, 1, 2, 0]]
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = []
    for doc in docs:
        h, before, score = np.zeros(3), gru.END, 0.0
        for token in doc:
            x, rec = w["x"][before] + w["b"], h @ w["h"]
            z, r = sig(x[:3] + rec[:3]), sig(x[3:6] + rec[3:6])
            n = np.tanh(x[6:] + r * rec[6:])
            h = z * h + (1 - z) * n
            c = int(np.searchsorted(m.bounds, token, "right") - 1)
            classes = np.exp(w["co"] @ h + w["cb"])
            a, b = m.bounds[c], m.bounds[c + 1]
            inside = np.exp(w["o"][a:b] @ h + w["ob"][a:b])
            score += math.log(classes[c] / classes.sum()) + (math.log(inside[token - a] / inside.sum()) if b - a > 1 else 0)
            before = token
        want.append(score)
    got = gru.score_documents(m, np.concatenate(docs).astype(np.int32), np.cumsum([0, *map(len, docs)]), n_lanes=2, window=2)
    assert np.allclose(got, want, rtol=1e-4)


def test_overlaps_by_hand():
    rng = np.random.default_rng(9)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        row = np.sort(rng.integers(0, 4, n))
        left = rng.integers(0, 25, n)
        right = left + rng.integers(0, 9, n)
        f = rng.integers(0, 3, n)
        want = []
        for i in np.unique(row).tolist():
            on = [len({int(f[k]) for k in range(n) if row[k] == i and left[k] <= x <= right[k]}) >= 2 for x in range(40)]
            want += [(i, x, next(y for y in range(x, 40) if not on[y]) - 1) for x in range(40) if on[x] and (x == 0 or not on[x - 1])]
        assert list(zip(*(v.tolist() for v in substring_dedup.overlaps(row, left, right, f, 2, 3)), strict=True)) == want
    # Two windows meet in the copy; in the source they do in the first row and not in the second.
    row, f = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    both = [np.array([0, 2, 0, 2]), np.array([20, 25, 20, 25]), f, np.array([5, 7, 5, 90]), np.array([30, 30, 30, 120])]
    assert [x.tolist() for x in substring_dedup.regions_of(both, row, 2, 2, 10)] == [[0], [2], [20]]


def test_every_edited_pair_is_found(spark):
    # Fragments of 49 words lead the windows of passages that later documents hold whole and with one word changed.
    rng, rows = random.Random(4), []
    for k in range(12):
        words = prose(11000 + k, 64).split()
        for a in (0, 3, 6, 9, 12, 15):
            rows.append(prose(12000 + len(rows), 40) + " " + " ".join(words[a : a + 49]) + " " + prose(13000 + len(rows), 40))
        for new in (None, [], ["changed"], ["two", "more"]):
            at = rng.randrange(20, 44)
            edited = words if new is None else words[:at] + new + words[at + 1 :]
            rows.append(prose(14000 + len(rows), 30) + " " + " ".join(edited) + " " + prose(15000 + len(rows), 30))
    rows += rows[-2:] * 2  # copies
    t = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    found = {(r["doc_id"], r["source_id"]) for r in substring_dedup.find_passages(t).collect()}
    sources = defaultdict(set)
    for d, s in found:
        sources[d] |= {d, s}
        sources[s].add(s)
    shingled = [tokens.shingles(*tokens.word_hashes(pa.array([r])))[0] for r in rows]
    pairs = [(j, i) for j in range(len(rows)) for i in range(j) if substring_dedup.match_passages(shingled[i], shingled[j], [(0, len(shingled[j]) - 1)], 46, 0.8)]
    assert len(pairs) > 36
    # A copy of a whole text is linked as the first of its text is.
    first = [rows.index(r) for r in rows]
    assert all((d, first[d]) in found for d in range(len(rows)) if first[d] < d)
    pairs = {(first[j], first[i]) for j, i in pairs if first[j] != first[i]}
    assert [p for p in pairs if p not in found and not sources[p[0]] & sources[p[1]]] == []


def test_a_short_passage_does_not_end_a_longer_one():
    # Runs of 18, 18 and 39 shingles: the first two are near-equal but short, all three fall short of 0.8, the last two pass.
    fresh = iter(range(1000, 2000))
    runs = [list(range(18)), list(range(18, 36)), list(range(36, 75))]
    other = lambda n: [next(fresh) for _ in range(n)]
    copy = runs[0] + other(4) + runs[1] + other(5) + runs[2]
    source = runs[0] + other(5) + runs[1] + other(5) + runs[2]
    got = substring_dedup.match_passages(np.array(source, np.uint64), np.array(copy, np.uint64), [(0, len(copy) - 1)], 46, 0.8)
    assert got == [(22, 83, 23, 84)]


def test_substring_rows_follow_the_documents(spark, tmp_path):
    # Families of edited texts have links by the square; the query gives one row a document, by classes, and counts the links.
    rows = []
    for k in range(3):
        words = prose(21000 + k, 120).split()
        for j in range(12):
            rows.append(" ".join(words[: 9 * j] + [f"new{j}"] + words[9 * j + 1 :]))
    rows += [prose(22000, 200), "", None, rows[0]]
    table = list(enumerate(rows)) + [(None, rows[12])]
    spark.createDataFrame(table, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    links, of = defaultdict(set), {d: k for k, (d, _) in enumerate(table)}
    for r in substring_dedup.find_passages(docs).collect():
        a, b = of[r["doc_id"]], of[r["source_id"]]
        links[a].add(b)
        links[b].add(a)
    got = substring_dedup.op2_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted(of[r["doc_id"]] for r in got) == [*range(36), 39, 40] == sorted(links)
    for r in got:
        k = of[r["doc_id"]]
        assert r["n_links"] == len(links[k]) and r["class_id"] == (12 if k == 40 else 0 if k == 39 else k // 12 * 12)
        held = {x for p in r["repeats"] for x in range(p["start"], p["start"] + p["n_words"])}
        assert r["repeated_words"] == len(held) and (len(held) > 100) == (k % 12 > 0 or k > 36)


def test_matching_many_copies_is_matching_each():
    rng = np.random.default_rng(8)
    seat = np.full(4000, -1, np.int32)
    for round_ in range(30):
        source = rng.permutation(3000)[:300].astype(np.int64)
        if round_ % 3 == 0:
            source[100:160] = source[20:80]  # shingles that the source holds twice
        parts = []
        for _ in range(20):
            a, n = rng.integers(0, 200), rng.integers(0, 100)
            part = source[a : a + n].copy()
            for at in rng.integers(0, max(1, n), rng.integers(0, 5)).tolist():
                part[at : at + rng.integers(1, 6)] = rng.integers(3000, 4000)
            parts.append(np.concatenate([rng.integers(3000, 4000, rng.integers(0, 30)), part, source[rng.integers(0, 250) :][:50]]))
        first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        got = substring_dedup.match_many(source, np.concatenate(parts), first, 46, 0.8, seat)
        want = {(k, *p) for k, c in enumerate(parts) for p in substring_dedup.match_passages(source, c, [(0, len(c) - 1)], 46, 0.8)}
        assert want and {tuple(r) for r in got.tolist()} == want and len(got) == len(want)
        assert (seat == -1).all()


def test_pairs_of_lists_count_once(spark):
    rng, lists = random.Random(3), []
    for _ in range(120):
        group = rng.randrange(5) * 100
        rids = sorted(rng.sample(range(group, group + 40), rng.choice((2, 2, 3, 9))))
        copies = rng.sample(range(group + 40, group + 60), rng.randrange(3)) if (exact := rng.randrange(2)) else []
        lists.append((rids[0], sorted([-1 - c for c in copies]) + rids, exact))
    lists.append((7, [-1 - 90, 7], 1))  # a text and its copy alone
    code: dict[tuple[int, int], int] = {}
    for head, rids, exact in lists:
        own = [r for r in rids if r >= 0]
        for p in itertools.combinations(own, 2):
            code[p] = max(code.get(p, 0), 1 + exact + (exact and p[0] == head))
        for c in rids[: len(rids) - len(own)]:
            code[head, -1 - c] = 3
    want = {p for p, c in code.items() if c != 2}
    table = spark.createDataFrame(lists, "head long, rids array<long>, exact int")
    # Large heads pass their lists on one by one; a grid of cells holds each pair once too.
    for most, dense in ((512, 4096), (512, 3), (4, 4096)):
        rows = substring_dedup.pairs_in(table, 3, most, dense).collect()
        assert {(r["leader"], r["rid"]) for r in rows} == want and len(rows) == len(want)
        assert len({r["cell"] for r in rows}) > (60 if most == 4 else 20)
