import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from voxelloom.llm import packing, token_files, tokenize

from tests.llm import helpers as H

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", FILES)
def test_encoder_equals_the_library(name):
    lib, own = library(name), tokenize.Encoder(P.path(name))
    rnd = random.Random(3)
    letters = [chr(i) for i in range(256)] + list("  \n\n'strevmlld") * 6 + ["é", "東", " ", "İ", "<|endoftext|>"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)]
    texts += [a + chr(c) + b for c in range(256) for a in ("a", "1", ".", " ", "\n") for b in ("a", "1", ".", " ", "")]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts_equal_the_library(spark):
    lib = library(FILES[0])
    got = H.rows(tokenize.count_tokens(H.edge_docs(spark), P.path(FILES[0])), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for doc, text, _ in H.edge_rows():
        n = len(lib.encode(text or "", add_special_tokens=False))
        want.append((doc, len((text or "").encode()), n, n > 1024))
    assert got == sorted(want, key=lambda t: [(x is not None, x) for x in t])
    assert tokenize.count_tokens(H.empty_docs(spark), P.path(FILES[0])).count() == 0


def test_whole_tokens_are_proven():
    lib = library(FILES[0])
    whole = tokenize.whole_tokens(P.path(FILES[0]))
    assert len(whole) > 40_000
    assert all(len(lib.encode(x, add_special_tokens=False)) == 1 for x in whole[::97])


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 64, 65, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        planes = token_files.to_planes(ids, kind, 64)
        assert len(planes) == (4 if kind == "byte" else 32)
        assert (token_files.from_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_give_back_every_document_in_order(spark, kind):
    lib = library(FILES[0])
    read = token_files.token_files(H.edge_docs(spark), P.path(FILES[0]), end_id=0, kind=kind, chunk_ids=100)
    got = sorted(read.collect(), key=lambda r: r["start"])
    want = sorted(((d, t or "") for d, t, _ in H.edge_rows()), key=lambda x: (x[0] is not None, x[0], x[1]))
    at = 0
    for r, (doc, text) in zip(got, want, strict=True):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc, at, len(ids))
        assert ids == [*lib.encode(text, add_special_tokens=False).ids, 0]
        at += len(ids)
    assert token_files.token_files(H.empty_docs(spark), P.path(FILES[0])).count() == 0


def test_fill_comes_as_close_as_any_subset():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = [rnd.randint(1, 40) for _ in range(rnd.randint(1, 8))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        sums = {0}
        for n in lengths:
            sums |= {s + n for s in sums}
        chosen = packing.fill(dict(counts), 60)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= 60)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_packing_holds_every_id_once(spark):
    docs = H.edge_docs(spark).unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), (F.col("id") % 97 * 11).cast("int")).alias("text")), allowMissingColumns=True)
    pieces = packing.pack(docs, P.path(FILES[1]), end_id=1, window=256).collect()
    lib = library(FILES[1])
    want = sorted([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.select("text").collect())
    docs_ids, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert r["length"] == len(r["ids"]) // 4 > 0
        docs_ids[r["doc_id"], r["doc_tokens"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(len(p) for ps in docs_ids.values() for _, p in ps) == sum(map(len, want))
    unique = {k: v for k, v in docs_ids.items() if k[0] is not None and k[0] >= 100}
    for (doc, n), parts in unique.items():
        flat = [i for _, p in sorted(parts) for i in p]
        assert len(flat) == n and flat == [*lib.encode("some words " * (doc % 97 * 11), add_special_tokens=False).ids, 1]
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding == 0
    assert packing.pack(H.empty_docs(spark), P.path(FILES[1])).count() == 0


def test_digest_and_assembly_agree(spark):
    docs = spark.createDataFrame([(k, "alpha beta " * (k * 40)) for k in range(12)], "doc_id long, text string")
    pieces = packing.pack(docs, P.path(FILES[1]), window=128)
    crc = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.digest(pieces).collect()}
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.assemble(pieces).collect()}
    for r in pieces.collect():
        part = whole[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]
        assert part == bytes(r["ids"]) and zlib.crc32(part) == crc[r["sequence_id"], r["offset"]]


def test_token_files_keep_the_pre_tokens_of_a_task():
    """op2_token_files dropped pre-tokens from a table of 300,000 and merged them again, several times in a task of text with many words."""
    of, made = tokenize.encoder(P.path("byte_bpe_50k.json"), token_files.TABLE_ENTRIES), []
    make, of.memo.make = of.memo.make, lambda word: made.append(word) or b""
    try:
        words = [f"w{n:b}".replace("0", "x").replace("1", "y") for n in range(320_000)]
        for _ in range(2):
            of.encode(" ".join(words))
        assert len(made) == len(set(words))
    finally:
        of.memo.make = make
        of.memo.clear()
        of.memo.older = {}
