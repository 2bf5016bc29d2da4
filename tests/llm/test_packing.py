"""Packing against the tokenizer itself and the properties of a packing."""

import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import packing, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, piece int, length string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85\xa0'’s.,!Σς́aAéÉ0<|>"))))
def test_ids_are_the_tokenizers(text):
    t = Tokenizer.from_file(PATH) if not hasattr(packing, "_t") else packing._t
    packing._t = t
    encode = packing.encoder(open(PATH, encoding="utf-8").read())
    assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_and_long_texts(tokenizer, monkeypatch):
    encode = packing.encoder(open(PATH, encoding="utf-8").read())
    monkeypatch.setattr(packing, "SEGMENT", 50)
    for text in ("a<|endoftext|>b <|startoftext|>", "it's  we'll　x", "word " * 500, "x" * 3000, ("ab\n" * 40 + "c" * 90) * 3, "<|end oftext|>"):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Exact minimum by trying all ways, for tiny inputs."""
    best = len(lengths)

    def place(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity:
                place(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        place(rest[1:], [*bins, rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold_and_bins_fit(lengths):
    n = np.array(lengths, dtype=np.int64)
    bins, offsets, used = packing.best_fit_decreasing(n, 20)
    least = fewest(lengths, 20)
    assert packing.lower_bound(n, 20) <= least <= used
    taken = defaultdict(list)
    for b, o, k in zip(bins.tolist(), offsets.tolist(), lengths, strict=True):
        taken[b].append((o, k))
    assert len(taken) == used
    for own in taken.values():
        at = 0
        for o, k in sorted(own):
            assert o == at
            at += k
        assert at <= 20


def check_packing(rows, tokenizer, docs):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(docs)
    for i, text in docs.items():
        ids = np.array(plain_ids(tokenizer, text), dtype="<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 4096)))
        for r in own:
            part = ids[4096 * r["piece"] : 4096 * (r["piece"] + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * r["piece"], len(part), zlib.crc32(part.tobytes()))
    for own in by_seq.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    lengths = np.array([r["length"] for r in rows])
    return len(by_seq), packing.lower_bound(lengths, 4096)


def test_query_packs_everything_tightly(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, bound = check_packing(queries.op8_best_fit_packing(spark, SF).collect(), tokenizer, docs)
    assert used <= bound * 1.01 + 1


def test_exchange_between_partitions_saves_bins(spark):
    rng = np.random.default_rng(3)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 101, 4000))], "id long, piece int, start long, length long, ids_crc32 long")
    alone = packing.pack(pieces, 100, part_bins=20, rounds=0).select("sequence_id").distinct().count()
    got = packing.pack(pieces, 100, part_bins=20)
    both = got.select("sequence_id").distinct().count()
    lengths = np.array([r["length"] for r in got.collect()])
    assert len(lengths) == 4000 and packing.lower_bound(lengths, 100) <= both < alone


def test_odd_rows(spark, tokenizer):
    rows = [(1, None, 9, "c"), (2, "", 9, "c"), (3, "a " * 30_000, 9, "c"), (4, "b " * 4095, 9, "c"), (5, "b " * 4096, 9, "c"), (None, "x", 9, "c")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), PATH).withColumnRenamed("id", "doc_id").collect()
    check_packing(got, tokenizer, {r[0]: r[1] for r in rows})
    twice = packing.pack_documents(spark.createDataFrame([rows[0], rows[0], rows[3], rows[3]], DOCS), PATH)
    assert twice.count() == 4
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


@pytest.mark.parametrize("hot", [7, None])
def test_equal_and_null_ids_are_dealt_evenly(spark, hot):
    schema = "id long, piece int, start long, length long, ids_crc32 long"
    rows = [(hot if i % 2 or hot is None else i, 0, 0, 50, 0) for i in range(8000)]
    got = packing.pack(spark.createDataFrame(rows, schema), 100, part_bins=100)
    parts = [r["n"] for r in got.withColumn("part", F.shiftright("sequence_id", 24)).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert sum(parts) == 8000 and len(parts) >= 30 and max(parts) <= 2 * sum(parts) / len(parts)


def test_large_ids_beside_null_ids(spark):
    ids = [None, 1 << 53, (1 << 53) + 1, None, -(1 << 62) - 1]
    rows = [(i, 0, 0, 10 + k, k) for k, i in enumerate(ids)]
    got = packing.pack(spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long"), 100).collect()
    assert sorted(((r["id"], r["ids_crc32"]) for r in got), key=lambda x: x[1]) == [(i, k) for k, i in enumerate(ids)]


def test_another_vocabulary_encodes_whole_texts(tokenizer):
    layout = json.loads(open(PATH, encoding="utf-8").read())
    layout["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    spec = json.dumps(layout)
    assert packing._word_model(spec, Tokenizer.from_str(spec)) is None
    assert packing._word_model(json.dumps(json.loads(open(PATH, encoding="utf-8").read())), tokenizer) is not None
    text = "two words, and more"
    assert np.frombuffer(packing.encoder(spec)(text), "<u4").tolist() == Tokenizer.from_str(spec).encode(text, add_special_tokens=False).ids


def test_sequences_hold_the_tokens(spark, tokenizer):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "x " * 5000)], "doc_id long, text string")
    packed = packing.pack_documents(docs, PATH)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, packed, PATH).collect()}
    for r in packed.collect():
        ids = np.array(got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], dtype="<u4")
        assert zlib.crc32(ids.tobytes()) == r["ids_crc32"]
