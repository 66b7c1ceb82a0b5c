"""The pipeline stage by stage against plain Python, and on odd tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rotorlens.llm import common, source_mix
from tests.llm.test_operators import DOCS, ODD, SMALL, _near_by_brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def _rows(spark, docs):
    return sorted(map(tuple, docs.select("doc_id", "text").collect()), key=str)


def _stored(docs):
    return common.stored(docs, "test-docs")


def _stays(rows):
    """Exact dedup by plain Python: of texts that are equal without white space, the longest, then the least id."""
    best = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        rank = (-len(t or ""), i is None, i if i is not None else 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, (i, t))
    return sorted((row for _, row in best.values()), key=str)


def test_exact_stage_by_brute_force(spark):
    docs = common.table(spark, SMALL, "documents")
    rows = _rows(spark, docs)
    assert _rows(spark, _stage("exact dedup")(spark, _stored(docs), SMALL)) == _stays(rows)
    assert len(_stays(rows)) < len(rows)


def test_near_stage_by_brute_force(spark):
    docs = _stored(common.table(spark, SMALL, "documents"))
    component = _near_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()])
    least = {}
    for i, root in component.items():
        least[root] = min(i, least.get(root, i))
    kept = _stage("simhash near-dedup")(spark, docs, SMALL)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(least.values())


def test_near_stage_finds_every_copy_at_or_above_the_similarity(spark):
    """Recall by bands of Jaccard similarity: all at 0.8 and above, none below."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, near = [], {}
    for g in range(120):
        words = [word() for _ in range(150)]
        changed = list(words)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 5])):
            changed[k] = word()
        sets = [set(zip(*[w[k:] for k in range(5)])) for w in (words, changed)]
        near[2 * g] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(changed))]
    kept = {r["doc_id"] for r in _stage("simhash near-dedup")(spark, _stored(spark.createDataFrame(rows, "doc_id long, text string")), SMALL).collect()}
    assert all((g + 1 in kept) == (similarity < 0.8) for g, similarity in near.items())
    assert {round(s, 1) for s in near.values()} >= {0.7, 0.8, 0.9}


def test_mix_stage_repeats_whole_documents_to_the_targets(spark):
    docs = _stored(common.table(spark, SMALL, "documents"))
    mixed = _stage("source mix")(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    size = F.regexp_count("text", F.lit(common.WORD))
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    goals = {r["source"]: r for r in source_mix.mix(docs).select("source", "source_size", "target").distinct().collect()}
    longest = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.max(size).alias("n")).collect()}
    for source, r in goals.items():
        assert abs(taken.get(source, 0) - r["target"]) <= longest[source] / 2 + 1
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3 * docs.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    again = _stage("source mix")(spark, docs.repartition(5), SMALL)
    assert _rows(spark, again) == _rows(spark, mixed)


def test_mix_of_repeated_and_nameless_rows(spark):
    rows = [(None, "s", "w " * (k % 7 + 1)) for k in range(60)] + [(1, "s", "a b c")] * 50 + [(2, "t", "x y")] * 3 + [(3, None, None)] * 2
    frame = _stored(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4))
    first = sorted(map(tuple, source_mix.mix(frame).collect()), key=str)
    assert first == sorted(map(tuple, source_mix.mix(_stored(frame.repartition(3))).collect()), key=str) and len(first) == len(rows)
    by = {}
    for r in source_mix.mix(frame).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(got - target) <= 1 for target, got in by.values())
    whole = source_mix.repeated(frame).groupBy("source").agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD))).alias("n"))
    assert all(abs(r["n"] - by[r["source"]][0]) <= 7 for r in whole.collect() if r["source"])


def test_run_writes_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"] and rows
    docs = common.table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = _stored(stage(spark, docs, SMALL))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    key = lambda r: (r["doc_id"], r["n_tokens"], tuple(r["token_ids"]))
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    odd = _stored(spark.createDataFrame(ODD, DOCS))
    n = _stage(name)(spark, odd, SMALL).count()
    if name == "exact dedup":
        assert n == len(_stays([(r[0], r[1]) for r in ODD]))
    if name == "simhash near-dedup":
        assert n == 6
    if name == "sentencepiece":
        assert n == len(ODD)
    assert _stage(name)(spark, odd.limit(0), SMALL).count() == 0


def test_dedup_state_is_kept_between_calls(spark, tmp_path):
    """Two batches of files through one state give what one call over both gives."""
    from rotorlens.llm import exact_dedup

    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(40)]
    path, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        kept = exact_dedup.exact_dedup(spark, path + "/", state_dir=state)
        got = sorted(map(tuple, kept.select(columns).collect()))
        assert got == sorted(map(tuple, exact_dedup.exact_dedup(spark, path).select(columns).collect()))
    names = spark.read.parquet(path).select(F.concat(F.lit("d"), F.format_string("%03d", "doc_id")).alias("doc_id"), "text")
    names.write.parquet(f"file://{tmp_path}/named")
    assert {r["keep_id"][1:] for r in exact_dedup.exact_dedup(spark, f"file://{tmp_path}/named").collect()} == {f"{g[1]:03d}" for g in got}
