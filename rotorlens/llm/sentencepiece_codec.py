"""SentencePiece encoding and decoding of whole tables; the lattice itself is in bpe_lattice.

Texts up to `chunk` characters are one chunk, traced where they are. Longer ones are cut: chunk rows
spread over the cluster give their transfers, neighbours' transfers are combined in a tree, the states at the
cuts come down the same tree, and the chunks are traced back independently. A text's ids come together only as its result.

Defined cases: a null or empty text has no ids and decodes to ''; U+2581 in a text decodes as a space, as
the model has it; rows that repeat are encoded each on its own; an empty table gives an empty result; other
columns are kept by encode() unless a name clashes with token_ids, which is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import common
from .bpe_lattice import SPACE, Model, combine, cut_states

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 50_000
#: Neighbouring transfers that are combined at a time.
FAN = 8
_models: dict[int, Model] = {}


def _model(data) -> Model:
    """One model per worker process; data is a broadcast of the model file's bytes."""
    key = hash(data.value)
    if key not in _models:
        _models.clear()
        _models[key] = Model(data.value)
    return _models[key]


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Path(path).read_bytes())  # a vocabulary: a few MB at most


def _encode_batches(data, check: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        # Some hundred texts at a time, so that what a worker holds does not follow the size of a batch.
        for b in (whole.slice(at, 500) for whole in batches for at in range(0, max(1, whole.num_rows), 500)):
            ids, same = [], []
            for value in b.column("__rl_text"):  # one text becomes a Python object at a time
                text = value.as_py()
                ids.append(model.encode(text) if text else np.zeros(0, np.int32))
                if check:
                    same.append(model.decode(ids[-1].tolist()) == text.replace(SPACE, " "))
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            kept = [n for n in b.schema.names if n != "__rl_text"]
            checked = [pa.array(same, pa.bool_())] if check else []
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], array, *checked], [*kept, "token_ids", *([check] if check else [])])

    return run


def _giant_ids(giants: DataFrame, data, chunk: int) -> DataFrame:
    """__rl_key, token_ids of rows (__rl_key, __rl_text)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(data)
        near = model.longest
        for b in batches:
            for key, text in zip(b["__rl_key"], b["__rl_text"]):
                text = model.marked(text)
                yield pd.DataFrame([(key, k, text[max(0, at - near) : at], text[at : at + chunk], text[at + chunk : at + chunk + near]) for k, at in enumerate(range(0, len(text), chunk))], columns=["key", "k", "before", "chunk", "after"])

    def transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(data)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "k": b["k"], "moves": [pickle.dumps(model.transfer(*r)) for r in zip(b["before"], b["chunk"], b["after"])]})

    def combined(key, b: pd.DataFrame) -> pd.DataFrame:
        """One transfer for FAN neighbouring stretches."""
        found = [pickle.loads(m) for m in b.sort_values("k")["moves"]]
        return pd.DataFrame({"key": [key[0]], "k": [key[1]], "moves": [pickle.dumps(reduce(combine, found))]})

    def settled(key, above: pd.DataFrame, below: pd.DataFrame) -> pd.DataFrame:
        """The states at the cuts inside a stretch, from those at its ends."""
        if not len(above) or not len(below):
            return pd.DataFrame({"key": [], "k": [], "ends": []})
        below, ends = below.sort_values("k"), pickle.loads(above["ends"].iloc[0])
        states = cut_states([pickle.loads(m) for m in below["moves"]], *ends)
        return pd.DataFrame({"key": below["key"], "k": below["k"], "ends": [pickle.dumps(pair) for pair in zip(states, states[1:])]})

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(data)
        for b in batches:
            ids = []
            for chunk, after, ends in zip(b["chunk"], b["after"], b["ends"]):
                entry, leave = pickle.loads(ends)
                ids.append(model.trace(entry, chunk, after, leave))
            yield pd.DataFrame({"key": b["key"], "k": b["k"], "ids": ids})

    chunks = common.stored(giants.mapInPandas(common.lean(cut), "key long, k int, before string, chunk string, after string"), "codec-chunks")
    # Up: transfers of neighbours are combined, FAN by FAN, until a text is one stretch. Down: the states at a stretch's
    # ends give those at the cuts inside it. No task holds more than FAN transfers of a text, however long it is.
    levels = [common.stored(chunks.mapInPandas(common.lean(transfers), "key long, k int, moves binary"), "codec-moves")]
    while levels[-1].where("k > 0").limit(1).count():
        groups = levels[-1].withColumn("up", F.expr(f"k div {FAN}").cast("int")).groupBy("key", "up")
        levels.append(common.stored(groups.applyInPandas(combined, "key long, k int, moves binary"), "codec-moves"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [cut_states([pickle.loads(m)]) for m in b["moves"]]
            yield pd.DataFrame({"key": b["key"], "k": b["k"], "ends": [pickle.dumps((x[0], x[-1])) for x in found]})

    states = levels[-1].mapInPandas(ends, "key long, k int, ends binary")
    for moves in reversed(levels[:-1]):
        within = moves.withColumn("up", F.expr(f"k div {FAN}").cast("int"))
        states = common.stored(states.withColumnRenamed("k", "up").groupBy("key", "up").cogroup(within.groupBy("key", "up")).applyInPandas(settled, "key long, k int, ends binary"), "codec-states")
    traced = chunks.join(states, ["key", "k"]).mapInPandas(common.lean(trace), "key long, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select(F.col("key").alias("__rl_key"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("token_ids"))


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", chunk: int = CHUNK, check: str | None = None) -> DataFrame:
    """docs with token_ids (array of int) instead of text_col.

    check names a further column, true where the ids decode to the text. A text that is one chunk is decoded
    by the worker that encoded it: a second Python step in the same task would double the workers and their caches.
    """
    data = _shared(docs.sparkSession, model_path)
    others = [c for c in docs.columns if c not in (text_col, "token_ids", check)]
    marked = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("__rl_text"))
    small = marked.where(F.length("__rl_text") <= chunk)
    schema = marked.drop("__rl_text").schema.add("token_ids", ArrayType(IntegerType()))
    if check:
        schema = schema.add(check, "boolean")
    encoded = small.mapInArrow(common.lean(_encode_batches(data, check)), schema)
    giants = marked.where(F.length("__rl_text") > chunk).withColumn("__rl_key", F.monotonically_increasing_id())
    giants = common.stored(giants, "codec-giants")  # fixes the keys
    ids = _giant_ids(giants.select("__rl_key", "__rl_text"), data, chunk)
    if not check:
        return encoded.unionByName(giants.drop("__rl_text").join(ids, "__rl_key").select(*others, "token_ids"))
    # Ids are written once; only hashes of the texts that come back meet the originals.
    ids = common.stored(ids, "codec-giant-ids")
    back = decode(ids, model_path, name="__rl_back").select(F.col("__rl_key").alias("__rl_of"), F.sha2("__rl_back", 256).alias("__rl_back"))
    wanted = giants.withColumn("__rl_text", F.sha2(F.translate("__rl_text", SPACE, " "), 256))
    met = wanted.join(ids, "__rl_key").join(back, F.col("__rl_key") == F.col("__rl_of"))
    return encoded.unionByName(met.select(*others, "token_ids", (F.col("__rl_text") == F.col("__rl_back")).alias(check)))


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "token_ids", name: str = "text") -> DataFrame:
    """encoded with the text of its ids, as column `name`."""
    data = _shared(encoded.sparkSession, model_path)
    others = [c for c in encoded.columns if c not in (ids_col, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data)
        for b in batches:
            column = b.column("__rl_ids")  # one document's ids become Python objects at a time
            values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_pylist()
            texts = [model.decode(values[i:j].tolist()) for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in others], pa.array(texts, pa.string())], [*others, name])

    chosen = encoded.select(*others, F.col(ids_col).alias("__rl_ids"))
    return chosen.mapInArrow(run, encoded.select(*others).schema.add(name, "string"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids_hash and whether the ids decode to the text, for every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    ids = encode(docs, check="round_trip")
    return ids.select("doc_id", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), F.xxhash64("token_ids").alias("ids_hash"), "round_trip")
