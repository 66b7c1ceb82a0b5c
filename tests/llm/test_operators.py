import collections
import math
import os
import random
import re
import urllib.parse
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlens.llm import bpe_lattice, common, exact_dedup, html_extract, license_scan, lm_score, quality_classifier, registry, sentencepiece_codec, shingle_join, simhash, source_mix, token_counts, topk_search
from tests.parity import differences

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, label string"
ODD = [
    (1, "the MIT License and the Apache  License", "en", "a", 39, 0, "x", "y"), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, "", ""), (4, "  \t\n ", "de", "b", 6, 1, "", ""),
    (5, "word " * 3000, "en", "a", 15000, 1, "", ""), (6, "the MIT License and the Apache  License", "en", "a", 39, 0, "x", "y"), (6, "the MIT License and the Apache  License", "en", "a", 39, 0, "x", "y"),
    (None, "no name", "fr", None, 7, 2, None, None), (8, "x" * 70000, "en", "c", 70000, 1, "", ""), (9, "GENERAL public licenseé general-public LICENSE", "en", "c", 1, 1, "", ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, registry.QUERIES[name], registry.ORACLES[name]) == []


def _labels(spark):
    return spark.createDataFrame([(1, 1, 0), (None, 1, 0), (99, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_odd_rows_and_empty_tables(spark, odd, empty):
    fits = {
        "counts": lambda d: token_counts.edited(token_counts.trees(token_counts.redactions(d))), "codec": sentencepiece_codec.encode, "simhash": simhash.near_dedup,
        "mix": source_mix.mix, "licences": license_scan.scan, "lm": lm_score.score, "quality": lambda d: quality_classifier.scores(d, _labels(spark)),
    }
    for name, make in fits.items():
        n = make(odd).count()
        assert n == len(ODD), name
        assert make(empty).count() == 0, name


def test_token_counts_after_edits():
    counter = token_counts.Counter(open(token_counts.RANKS_PATH, "rb").read())
    rng = random.Random(5)
    for _ in range(150):
        letters = rng.choice(["ab  \n't s1é.", "a½²b_\x1c ́x\x85 5", " \n\t"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 9, 400])))
        tree = token_counts.Tree(counter, text)
        for _ in range(4):
            a = rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 1, 60])), "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 90])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert tree.text() == text and tree.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_trees_are_kept_between_batches_of_edits(spark):
    """Two batches on kept trees give the counts of the whole text, and encode next to nothing but what they touch."""
    encoding = token_counts.Counter(open(token_counts.RANKS_PATH, "rb").read()).encoding
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["boat", "harbour", "12", "it's", "the"]) for _ in range(rng.choice([0, 3, 2000]))), "x") for i in range(30)]
    batch = {}
    for turn in range(2):
        batch[turn] = [(i, [(0, rng.randint(0, 40), rng.randint(41, 60), "new words") for _ in range(i % 3)]) for i, *_ in rows]
    edits = "__id long, edits array<struct<seq:int,start:int,stop:int,replacement:string>>"
    kept = token_counts.trees(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    texts = {i: t for i, t, _ in rows}
    for turn in range(2):
        kept = common.stored(token_counts.edited(kept.join(spark.createDataFrame(batch[turn], edits), F.col("doc_id") == F.col("__id")).drop("__id")), "trees")
        for i, found in batch[turn]:
            for _, a, b, new in sorted(found):
                t = texts[i]
                a, b = min(a, len(t)), min(b, len(t))
                texts[i] = t[:a] + new + t[max(a, b) :]
        got = kept.collect()
        assert all(r["text"] == texts[r["doc_id"]] and r["n_tokens_after"] == len(encoding.encode_ordinary(r["text"])) and r["n_chars_after"] == len(r["text"]) for r in got)
        assert all(r["n_reencoded"] <= 30 * r["n_edits"] for r in got) and len(got) == 30


def test_token_counts_query_by_brute_force(spark):
    encoding = token_counts.Counter(open(token_counts.RANKS_PATH, "rb").read()).encoding
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SMALL, "documents").collect()}
    rows = registry.QUERIES["op1_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(texts) and sum(r["n_edits"] for r in rows) > 0
    for r in rows:
        before = texts[r["doc_id"]]
        after, n = re.subn(token_counts.PRIVATE, token_counts.PLACEHOLDER, before)
        assert (r["n_chars"], r["n_edits"], r["n_chars_after"]) == (len(before), n, len(after))
        assert (r["n_tokens"], r["n_tokens_after"]) == (len(encoding.encode_ordinary(before)), len(encoding.encode_ordinary(after)))


def test_codec_equals_the_library_and_chunks_agree(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for chunk in (50_000, 700):
        encoded = sentencepiece_codec.encode(docs, chunk=chunk)
        rows = encoded.collect()
        assert len(rows) == len(texts) and all(list(r["token_ids"]) == library.encode(texts[r["doc_id"]]) for r in rows)
        assert all(r["text"] == texts[r["doc_id"]] for r in sentencepiece_codec.decode(encoded).collect())
        checked = sentencepiece_codec.encode(docs.selectExpr("*", "1 AS same"), chunk=chunk, check="same").collect()
        assert sorted((r["doc_id"], list(r["token_ids"])) for r in checked) == sorted((r["doc_id"], list(r["token_ids"])) for r in rows) and all(r["same"] is True for r in checked)
    model = bpe_lattice.Model(open(sentencepiece_codec.MODEL_PATH, "rb").read())
    rng, near = random.Random(3), model.longest
    for k in range(200):
        text = model.marked("".join(rng.choice("ab thein▁é日 \n0,") for _ in range(rng.randint(1, 200))))
        size = rng.choice([1, 3, 17, 64])
        cuts = [(text[max(0, i - near) : i], text[i : i + size], text[i + size : i + size + near]) for i in range(0, len(text), size)]
        moves = [model.transfer(*c) for c in cuts]
        states = bpe_lattice.cut_states(moves)
        ids = np.concatenate([model.trace(states[i], c[1], c[2], states[i + 1]) for i, c in enumerate(cuts)])
        assert ids.tolist() == model.encode_marked(text).tolist()
        if len(moves) > 3:
            left = bpe_lattice.combine(bpe_lattice.combine(moves[0], moves[1]), moves[2])
            assert left == bpe_lattice.combine(moves[0], bpe_lattice.combine(moves[1], moves[2]))


def test_codec_round_trip_of_odd_rows(spark, odd, empty):
    for chunk in (50_000, 900):
        rows = sentencepiece_codec.encode(odd, chunk=chunk, check="round_trip").collect()
        assert len(rows) == len(ODD) and all(r["round_trip"] is True for r in rows)
        assert {r["doc_id"]: len(r["token_ids"]) for r in rows if r["doc_id"] in (2, 3)} == {2: 0, 3: 0}
    assert sentencepiece_codec.encode(empty, check="round_trip").count() == 0


def _topk_by_brute_force(v, ids, k=5):
    good = [(i, [math.floor(256 * c) for c in x]) for i, x in v if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    queries = {}
    for i, x in good:
        if i in ids:
            queries[i] = min(queries.get(i, x), x)
    return {q: [(n + 1, i, -s) for n, (s, i) in enumerate(sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q))[:k])] for q, x in queries.items()}


@pytest.mark.parametrize("size", [1 / 8, 900.0])
def test_topk_with_bad_vectors_ties_and_blocks(spark, size):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 6) * size]) for i in range(300)]
    v += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (None, [1.0]), (100, [1.0, 1.0]), (350, [30000.0] * 6)]
    frame = spark.createDataFrame([(i, x, "z") for i, x in v], "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in topk_search.topk(frame, frame.where("vec_id % 50 = 0"), query_block=3, candidate_block=40).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == _topk_by_brute_force(v, set(range(0, 400, 50)))


def test_topk_scores_beyond_the_fifteenth_digit():
    scores = np.array([[4 * 10**15, 4 * 10**15 + 1, -(10**18), 4 * 10**15]])
    at, hit = topk_search.best_of(scores, np.zeros((1, 4), bool), 2)
    assert hit.tolist() == [0, 1]
    at, hit = topk_search.best_of(scores, np.array([[False, True, False, False]]), 3)
    assert hit.tolist() == [0, 2, 3]
    least = np.full((1, 3), np.iinfo(np.int64).min)
    assert topk_search.best_of(least, np.array([[True, False, False]]), 5)[1].tolist() == [1, 2]


@pytest.mark.parametrize("before", ['<svg class="i"/>', "<math/>", '<svg viewBox="0 0 1 1"><path d="M0"/></svg>', "<video-player></video-player>", "<title-bar></title-bar>", "<object-card></object-card>"])
def test_html_text_after_raw_elements_stays(before):
    page = html_extract.Page(f"<html><body>{before}<article><p>Main</p></article></body></html>")
    assert "Main" in page.text and "path" not in "".join(page.text)


def test_simhash_components_equal_brute_force(spark):
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs, shard=40, radius=12).collect()}
    rows = sorted((r["doc_id"], simhash.fingerprint(r["text"])) for r in docs.collect())
    forest = simhash.Forest(len(rows))
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 12:
                forest.join(i, j)
    assert got == {rows[i][0]: rows[forest.find(i)][0] for i in range(len(rows))}
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_near_copies_of_the_pipeline_stage(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rows, groups = [], 0
    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(400)]
        for c in range(3):
            changed = list(words)
            for k in rng.sample(range(400), 4 * c):
                changed[k] = rng.choice(vocabulary)
            rows.append((3 * g + c, " ".join(changed)))
        groups += 1
    kept = sorted(r["doc_id"] for r in simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(range(0, 180, 3)) <= set(kept) and len(kept) <= groups + 2


def test_hot_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 7)
    points = np.array([1 << k for k in range(40)], np.uint64).reshape(-1, 1)
    dealt = spark.createDataFrame([(0, bytearray(p), True) for p in simhash.packed(points)], "shard long, fp binary, home boolean")
    edges = simhash.searched(dealt, 2).collect()
    assert simhash.components(spark.createDataFrame(edges, "a binary, b binary")).select("root").distinct().count() == 1


def test_no_task_holds_more_than_two_pieces_of_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 50)
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 1 << 12, 2000).astype(np.uint64)).reshape(-1, 1)
    home = rng.random(len(points)) < 0.7
    dealt = spark.createDataFrame([(0, bytearray(p), bool(h)) for p, h in zip(simhash.packed(points), home)], "shard long, fp binary, home boolean")
    sizes = [r["count"] for r in simhash.dealt_pieces(dealt).groupBy("shard", "first", "second").count().collect()]
    assert max(sizes) <= 3 * 50 and len(sizes) > 100
    forest, found = simhash.Forest(len(points)), simhash.Forest(len(points))
    for i in np.flatnonzero(home):
        for j in np.flatnonzero(simhash.distances(points, points[i]) <= 1):
            forest.join(int(i), int(j))
    at = {bytes(p): i for i, p in enumerate(simhash.packed(points))}
    for r in simhash.searched(dealt, 1).collect():
        found.join(at[bytes(r["a"])], at[bytes(r["b"])])
    assert [found.find(i) for i in range(len(points))] == [forest.find(i) for i in range(len(points))]


def _near_by_brute_force(rows):
    """Component of each row of (doc_id, text) by all pairs of whole shingle sets."""
    sets = [set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else {tuple(w)} - {()} for w in (t.lower().split() for _, t in rows)]
    forest = simhash.Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                forest.join(i, j)
    return {rows[i][0]: rows[forest.find(i)][0] for i in range(len(rows))}


def test_near_copies_keep_the_jaccard_contract(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(40):  # edits of a tail: similarities from 0.6 to 0.95, most of them near 0.8
        words = [word() for _ in range(204)]
        rows += [(10 * g + c, " ".join(words[: 204 - cut] + [word() for _ in range(cut)])) for c, cut in enumerate((0, 10, 21, 22, 23, 24, 30, 40))]
    expected = _near_by_brute_force(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for hot, sample in ((4000, 4000), (3, 100)):
        monkeypatch.setattr(shingle_join, "HOT", hot)
        monkeypatch.setattr(shingle_join, "SAMPLE", sample)
        assert {r["doc_id"]: r["component_id"] for r in shingle_join.near_dedup(frame).collect()} == expected
    assert len(set(expected.values())) > 80
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(frame).collect()}
    assert kept == set(expected.values())


def test_near_copies_of_a_large_group_keep_the_contract(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(4):  # groups in which a shingle is held often, with similarities around 0.8 between members
        words = [word() for _ in range(300)]
        for c in range(60):
            changed = list(words)
            for k in rng.sample(range(300), rng.choice([2, 5, 6, 7])):
                changed[k] = word()
            rows.append((60 * g + c, " ".join(changed)))
    expected = _near_by_brute_force(rows)
    assert 8 < len(set(expected.values())) < 200
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == expected


def test_prefixes_of_near_sets_meet_however_often_shingles_repeat():
    rng, none = np.random.default_rng(2), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for k in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 45)]
        other = words[:44] + [f"v{k}"]
        a, b = (shingle_join.shingles(" ".join(w * 4)) for w in (words, other))  # every shingle about four times
        if shingle_join.near(len(a), len(b), len(np.intersect1d(a, b))):
            assert set(shingle_join.prefix(a, *none).tolist()) & set(shingle_join.prefix(b, *none).tolist()), k
    assert len(shingle_join.shingles("a b c d e " * 50)) == 5


def test_wide_parities_never_differ_more_than_the_sets():
    rng = np.random.default_rng(7)
    for n in (0, 3, 300, 1500, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for cut in (0, n // 20, n // 3):
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, cut // 2).astype(np.uint64)]))
            gap = len(np.setxor1d(a, b))
            seen = shingle_join.differing(shingle_join.wide_parities(a), shingle_join.wide_parities(b))
            assert seen <= gap and (gap < 50 or seen > 0.6 * gap)


def test_near_copies_last_round_takes_all_pairs_within_bounds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**63, 100).astype(np.uint64) for _ in range(40)]  # node i + 40 has the set of node i
    rows = spark.createDataFrame([(7, i, 100, 5, 0 if i in (3, 43) else i + 100, 60) for i in range(60)], "shingle long, node long, n long, pos int, root long, held long")
    parity = spark.createDataFrame([(i, shingle_join.parities(sets[i % 40])) for i in range(60)], "node long, parity array<long>")
    for hot in (4000, 5):
        monkeypatch.setattr(shingle_join, "HOT", hot)
        found = [(r["a"], r["b"]) for r in shingle_join.candidates(rows, parity).collect()]
        assert sorted(found) == [(i, i + 40) for i in range(20) if i != 3]


def test_mix_targets_and_taken(spark):
    rows = [(i, s, "w " * n) for i, (s, n) in enumerate([("a", 10)] * 100 + [("b", 1)] * 50 + [(None, 7)] * 30 + [("c", 0)])]
    mixed = source_mix.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    taken, target = collections.Counter(), {}
    for r in mixed:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert target["b"] == 150 and target["c"] == 0 and sum(target.values()) == pytest.approx(1260)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)


def _scan_by_brute_force(rows):
    """Every column of the scan, text by text."""
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER))) for _, t in rows]
    total, held = len(rows), [set(w) for w in words]
    out = []
    places = {}
    for name, template in license_scan.TEMPLATES.items():
        tokens = template.split()
        idf = {w: math.log((total + 1) / (sum(w in h for h in held) + 1)) + 1 for w in tokens}
        rare = sorted(idf, key=lambda w: (-idf[w], w))[: license_scan.RARE_WORDS]
        places[name] = [(w, k, idf[w]) for k, w in enumerate(tokens) if w in rare]
    for (doc_id, _), w in zip(rows, words):
        at = lambda phrase: [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]  # noqa: E731, B023
        base = {label: at(phrase) for phrase, label in license_scan.BASE.items()}
        found, best = set(), 0.0
        for name, index in places.items():
            if not any(at(p) for p in license_scan.KEY_PHRASES[name]):
                continue
            votes = collections.Counter()
            for i, x in enumerate(w):
                for v, k, weight in index:
                    if v == x:
                        votes[i - k] += weight
            share = max(votes.values(), default=0) / sum(i for *_, i in index)
            if round(share, 9) >= license_scan.MIN_SHARE:
                found.add(license_scan.LABEL_OF.get(name, name))
                best = max(best, share)
        every = sorted(x for v in base.values() for x in v)
        labels = {k for k, v in base.items() if v}
        score = max(best, 0.5 if every else 0.0)
        out.append((doc_id, len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(labels)), ",".join(sorted(labels | found)), round(score, 6)))
    return sorted(out, key=str)


def test_licence_scan_by_brute_force(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SMALL, "documents").collect()] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [(10_000 + k, f"Files.\n{t.upper()}; and more") for k, t in enumerate(license_scan.TEMPLATES.values())]
    rows += [(20_000, "Redistribution of binary forms"), (20_001, " ".join(license_scan.TEMPLATES["bsd"].split()[:9]))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _scan_by_brute_force(rows)
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 6)) for r in got], key=str) == want
    named = {r["doc_id"]: r["labels"] for r in got}
    for k, name in enumerate(license_scan.TEMPLATES):
        assert license_scan.LABEL_OF.get(name, name) in named[10_000 + k].split(",")
    assert named[20_000] == ""


def test_exact_dedup_survives_colliding_digests(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    rows = [(1, "a b"), (2, "ab "), (3, "abc"), (4, None), (5, ""), (6, "ab "), (6, "ab ")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    for digest in (exact_dedup.sha256, lambda t: F.substring(F.md5(t), 1, 0)):
        got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(spark, path, digest=digest).collect())
        assert got[:5] == [(1, 1, 4 + 0, True), (2, 1, 4, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False)] and [g[3] for g in got[5:]] == [False, False]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 3000)
    monkeypatch.setattr(lm_score, "SLICE", 500)
    docs = common.table(spark, SMALL, "documents").select("doc_id", "text")
    rows = {r["doc_id"]: r for r in lm_score.score(docs).collect()}
    tokens = {r["doc_id"]: r["text"].encode().lower().split() + [b" "] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    for i, r in rows.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i]))
    mean = lambda c: sum(r[c] for i, r in rows.items() if held[i]) / sum(r["n_tokens"] for i, r in rows.items() if held[i])
    assert mean("score") > mean("base_score")


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    contexts = lm_score.Contexts(np.arange(100, 103, dtype=np.uint64), np.array([4, 5, 6]))
    word, context = np.divmod(np.arange(40 * contexts.size), contexts.size)
    v = lm_score.Vocabulary(contexts, np.arange(40, dtype=np.uint64), word, context, rng.integers(0, 4, len(word)) * (word > 0) + (word == 1))
    for sweep in range(3):
        v.sweep(v.totals(), np.random.default_rng(sweep), first=sweep == 0)
        for level, lower in ((v.middle, np.bincount(v.mid_of, v.leaf.t)), (v.root, np.bincount(v.mid_word, v.middle.t))):
            assert (level.c == lower).all() and (level.sizes > 0).all()
            assert (np.bincount(np.repeat(np.arange(len(level.t)), level.t), level.sizes, len(level.t)) == level.c).all()
        totals = v.totals()
        p = v.probabilities(totals)[2].reshape(40, contexts.size)
        # Word 0 was never seen in training: it stands for the one unknown token.
        assert p.sum(0) == pytest.approx(1.0)


def test_lm_seats_follow_the_restaurant_process():
    """Many copies of one dish with five customers: the share of each number of tables against all 52 seatings."""
    d, theta, others, parent, c = 0.7, 2.0, 6.0, 0.05, 5

    def seatings(n):
        if n == 0:
            yield []
            return
        for s in seatings(n - 1):
            for k in range(len(s)):
                yield s[:k] + [s[k] + 1] + s[k + 1 :]
            yield s + [1]

    weight = collections.Counter()
    for s in seatings(c):
        opened = math.prod((theta + d * (others + k)) * parent for k in range(len(s)))
        weight[len(s)] += opened * math.prod(math.prod(j - d for j in range(1, k)) for k in s)
    rng = np.random.default_rng(3)
    n = 60_000
    tables = lm_score.Tables(np.full(n, c), np.ones(n, np.int64), np.full(n, c))
    tables.gibbs(np.full(n, others), np.full(n, parent), d, theta, 60, rng)
    seen = np.bincount(tables.t, minlength=c + 1) / n
    for t in range(1, c + 1):
        assert seen[t] == pytest.approx(weight[t] / sum(weight.values()), abs=0.01)


def test_lm_knows_which_word_follows_which(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 700)
    rng = random.Random(1)
    words = [f"w{k}" for k in range(20)]
    after = {w: rng.sample(words, 2) for w in words}

    def walk(n):
        out = [rng.choice(words)]
        for _ in range(n):
            out.append(rng.choice(after[out[-1]]))
        return out

    rows = [(i, " ".join(walk(60))) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.sample(t.split(), 61))) for i, t in rows]  # the same words in any order
    learnt = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, t) for i, t in rows if i < 1000 or zlib.crc32(str(i).encode()) % 5 == 1]
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fluent = [got[i]["score"] / 61 for i in range(300) if i not in set(learnt)]
    mixed = [got[i]["score"] / 61 for i in got if i >= 1000]
    assert np.mean(fluent) > np.mean(mixed) + 0.5 and np.mean(fluent) > -0.6


def test_lm_blocks_do_not_grow_with_the_parts(spark, monkeypatch):
    """What is stored of the texts names each word of a block once, however many parts the vocabulary has."""

    class Stop(Exception):
        pass

    sizes, stored = [], common.stored

    def watched(df, name, instead_of=()):
        out = stored(df, name, instead_of)
        sizes.append(sum(os.path.getsize(urllib.parse.unquote(urllib.parse.urlparse(f).path)) for f in out.inputFiles()))
        raise Stop

    monkeypatch.setattr(common, "stored", watched)
    docs = common.table(spark, SMALL, "documents").coalesce(1)
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    for parts in (8, 200):
        monkeypatch.setattr(lm_score, "PART_CHARS", chars // parts)
        with pytest.raises(Stop):
            lm_score.score(docs)
    assert sizes[1] < 1.02 * sizes[0]


def test_lm_parts_are_served_in_as_many_turns_however_large_the_corpus_is():
    for parts, turns in ((8, 1), (32, 2), (64, 4), (376, 4), (1876, 4)):
        served = lm_score._turns(parts)
        assert len(served) == turns and [p for s in served for p in s] == list(range(parts))


def test_lm_scores_are_the_same_however_many_parts_are_served_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 20_000)
    monkeypatch.setattr(lm_score, "FAN", 2)
    docs = common.table(spark, SMALL, "documents")
    got = []
    for served in (3, 100):
        monkeypatch.setattr(lm_score, "SERVED", served)
        got.append(sorted(lm_score.score(docs, burn_in=1, samples=1).collect(), key=str))
    assert got[0] == got[1] and len(got[0]) == docs.count()


def test_lm_requests_hold_every_pair():
    """Requests of two blocks to all of 11 parts, some parts at a time, against counts by hand."""
    rng, parts, want, rows, before = random.Random(4), 11, collections.Counter(), [], (int(lm_score._hashes([lm_score.END])[0]), 0)
    last = lm_score.END
    for number in range(2):
        block = lm_score.Block()
        for doc in range(30):
            words = [b"w%d" % int(rng.paretovariate(0.7) % 5000) for _ in range(rng.randrange(60))]
            # The second block has its own words only, so that the token before it is none of them.
            words = [w + b"x" * number for w in words]
            held = doc % 3 == 0
            tail = [lm_score.END] if (number, doc) != (0, 29) else [b"last"]
            for pair in zip([last, *words], words + tail):
                want[pair] += not held
            last = tail[-1]
            block.add(doc, held, str(doc), words)
            block.add(doc, held, str(doc), tail)
        row, before = block.closed(number, before)
        rows.append(dict(zip([x.split()[0] for x in lm_score.BLOCK_SCHEMA.split(", ")], row)))
    name = {h: w for w in {w for pair in want for w in pair} for h in lm_score._hashes([w]).tolist()}
    got = {}
    for served in (range(0, 4), range(4, 5), range(5, 11)):
        asked = collections.defaultdict(list)
        for r in rows:
            for part, *x in lm_score.Pairs(r, parts).requests(served, True):
                asked[part].append(dict(zip("abcdef", x)))
        assert set(asked) <= set(served)
        for requests in asked.values():
            hashes, word, context, count, known, kinds = lm_score._sum_of(requests)
            assert kinds.tolist() == [lm_score.word_class(name[h]) if name[h] != lm_score.END else 0 for h in known.tolist()]
            for w, k, n in zip(word, context, count):
                got[name[int(known[k])], name[int(hashes[w])]] = int(n)
    assert got == dict(want)


def test_lm_tables_follow_at_once_where_few_dishes_move():
    rng = np.random.default_rng(5)
    c = rng.integers(0, 9, 3000)
    tables = lm_score.Tables.started(c, np.minimum(c, 2), 0.7, rng)
    to = c.copy()
    to[17], to[18], to[2000] = 400, 0, 77
    many = lambda x: np.full(3000, x)
    tables.follow(to, many(5.0), many(0.05), 0.7, 2.0, rng)
    assert (tables.c == to).all() and (tables.sizes > 0).all() and ((tables.t > 0) == (to > 0)).all()
    assert (np.bincount(np.repeat(np.arange(3000), tables.t), tables.sizes, 3000) == to).all()


def test_classifier_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    made = common.stored(quality_classifier.features(docs.selectExpr("*", "doc_id AS row"), ["doc_id", "row"]), "test-features")
    order = sorted((r["doc_id"] for r in labels.select("doc_id").distinct().collect()), key=lambda i: __import__("hashlib").md5(str(i).encode()).hexdigest())
    unseen = set(order[2600:])
    rows = labels.collect()
    marks = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in rows}
    low = {r["doc_id"] for r in rows if r["quality"] == 0}
    toxic = {r["doc_id"] for r in rows if r["toxic"] == 1}
    right = {}
    for rounds in (0, 3):
        model = quality_classifier.fit(docs, labels, labelled=2500, made=made, rounds=rounds)
        found = quality_classifier.classify(made, model, ["doc_id"]).collect()
        rejected = {r["doc_id"]: r["rejected"] for r in found}
        good = [not rejected[i] for i in unseen if marks[i]]
        print(rounds, np.mean(good), np.mean([rejected[i] for i in unseen & low]), np.mean([rejected[i] for i in unseen & toxic]), model.calibration.w, model.marks)
        assert np.mean(good) > 0.97 and np.mean([rejected[i] for i in unseen & low]) > 0.97
        assert np.mean([rejected[i] for i in unseen & toxic]) > 0.85
        right[rounds] = np.mean([rejected[i] != marks[i] for i in unseen])
    # Both views mark documents of both kinds in every round, and what they exchange does no harm.
    assert {(m["by"], m["good"]) for m in model.marks if m["rows"]} == {(v, g) for v in ("text", "metadata") for g in (True, False)}
    assert len(model.marks) == 12 and right[3] > right[0] - 0.005


def test_views_teach_each_other():
    """Each view alone sees half of what tells the kinds apart; marks of one carry over to the other."""
    rng = np.random.default_rng(5)

    def made(n):
        y = rng.integers(0, 2, n).astype(np.float32)
        words = [np.unique(np.concatenate([rng.integers(100, 160, 8), [10 + int(k)]])) for k in y]
        metas = [np.array([int(k) if rng.random() < 0.95 else 1 - int(k), 5]) for k in y]
        return [quality_classifier.Rows([[1.0, 0.0]] * n, words, 1000), quality_classifier.Rows([[1.0]] * n, metas, 50)], y

    (labelled, y), (pool, truth) = made(240), made(1500)
    free = np.ones(1500, bool)

    def surest(model, view, good, n):
        s = np.where(free, model.views[view].logits(pool[view]) * (1 if good else -1), -np.inf)
        top = np.argsort(-s, kind="stable")[:n]
        free[top] = False
        return [p.take(top) for p in pool], len(top) / 1500

    model = quality_classifier.co_train(labelled, y, surest, rounds=3, per_round=100)
    assert all(m["rows"] and m["weight"] > 0.3 for m in model.marks)
    assert np.mean((model.probability(pool)[2] > 0.5) == (truth > 0.5)) > 0.97


def test_near_pairs_move_a_row_a_few_times_however_many_pairs_it_is_in(spark, monkeypatch):
    """Every pair of 120 nodes is checked, and a node's set moves at most twice for each block."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 3000 - 10 * (i % 60)], rng.integers(0, 2**63, 10 * (i % 60)).astype(np.uint64)])) for i in range(120)]
    pairs = common.stored(spark.createDataFrame([(i, j) for i in range(120) for j in range(i + 1, 120)], "a long, b long"), "test-pairs")
    near = [(i, j) for i in range(120) for j in range(i + 1, 120) if shingle_join.near(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))]
    assert 1000 < len(near) < 7000
    moved = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, *a: moved.append((name, out := stored(df, name, *a))) or out)
    monkeypatch.setattr(shingle_join, "BLOCKS", 4)
    held = stored(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, found binary"), "test-sets")
    found = shingle_join.verified(pairs, held)
    assert sorted(map(tuple, found.collect())) == near
    times = dict(moved)["near-wanted"].groupBy("node").count().agg(F.max("count")).first()[0]
    assert times <= 8  # of 119 pairs
    marks = spark.createDataFrame([(i, len(s), bytearray(shingle_join.wide_parities(s))) for i, s in enumerate(sets)], "node long, n long, wide binary")
    assert set(near) <= set(map(tuple, shingle_join.bounded(pairs, marks).collect()))


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """SimHash's links are searched, and checked; the join gets what they leave over."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(30):
        words = [word() for _ in range(400)]
        rows += [(3 * g, " ".join(words)), (3 * g + 1, " ".join(words[:-1] + [word()])), (3 * g + 2, " ".join(words[:365] + [word() for _ in range(35)]))]
    sets = {i: shingle_join.shingles(t) for i, t in rows}
    votes = {i: sum(((int(h) >> k & 1) for h in s), 0) for k in (7,) for i, s in sets.items()}
    prints = {i: int.from_bytes(shingle_join.fingerprint(s), "big") for i, s in sets.items()}
    assert all((prints[i] >> 7 & 1) == (2 * votes[i] > len(sets[i])) for i in sets)
    close = {(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= shingle_join.RADIUS}
    frame = spark.createDataFrame([(i, bytearray(shingle_join.fingerprint(s))) for i, s in sets.items()], "node long, fp binary")
    found = {tuple(r) for r in shingle_join.alike(frame).collect()}
    assert found <= close and len(found) >= 20
    forests = [simhash.Forest(len(rows)) for _ in range(2)]
    for forest, edges in zip(forests, (close, found)):
        for a, b in edges:
            forest.join(a, b)
    assert [forests[0].find(i) for i in prints] == [forests[1].find(i) for i in prints]
    # Pairs that fingerprints link need no join: without its rounds, they are still components.
    monkeypatch.setattr(shingle_join, "prefix", lambda found, ranked, rank: found[:0])
    component = {r["doc_id"]: r["component_id"] for r in shingle_join.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = simhash.Forest(len(rows))
    for a, b in close:
        if shingle_join.near(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b]))):
            linked.join(a, b)
    assert component == {i: linked.find(i) for i in component} and len(set(component.values())) <= 75


def test_lm_rare_words_are_contexts_too(spark, monkeypatch):
    """More words than were once contexts, each with its own follower: scores know the followers of all of them."""
    monkeypatch.setattr(lm_score, "BLOCK", 40_000)
    n = 6000
    order = random.Random(2).sample(range(n), n)
    follows = dict(zip(order, order[1:] + order[:1]))
    at = {w: k for k, w in enumerate(order)}
    rows = []
    for i in range(200):
        start = i * (n // 200)
        rows.append((i, " ".join(f"w{order[(start + k) % n]:04d}" for k in range(240))))  # every word about eight times
    held = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 5 == 1]
    rng = random.Random(9)
    for i in held:
        start = rng.randrange(n)
        rows.append((i, " ".join(f"w{order[(start + k) % n]:04d}" for k in range(60))))
    got = {r["doc_id"]: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(follows) == len(at) == n and len(got) == len(rows)
    assert np.mean([got[i]["score"] / 61 for i in held]) > -1.2  # one of 6,000 by chance: -3.8


def test_codec_keeps_the_words_of_a_large_table(monkeypatch):
    """Words that a table has again are looked up, not encoded again, some hundred thousand of them."""
    with open(sentencepiece_codec.MODEL_PATH, "rb") as f:
        model = bpe_lattice.Model(f.read())
    made = collections.Counter()
    monkeypatch.setattr(model, "word_path", lambda word: made.update([word]) or [])
    for _ in range(2):
        for k in range(180_000):
            model.word(f"w{k}")
    assert max(made.values()) == 1
