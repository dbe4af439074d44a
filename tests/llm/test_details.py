"""Rows, characters, blocks and structures that only some operators have to get right."""

import base64
import json
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from voxelloom.llm import _text as T
from voxelloom.llm import context_tree as C
from voxelloom.llm import fm_index, linear, preferences, quality, secret_scan, token_files, tokenize, toxicity

from tests.llm import helpers as H
from tests.llm.test_models import labelled
from tests.llm.test_secret_scan import b64, der, kinds


def one(text):
    return next(T.chunks(pa.array([text], pa.string())))


def test_inner_keys_are_parsed():
    algorithm = der(0x30, der(6, b"\x2a\x86\x48"))
    pkcs8 = lambda inner, extra=b"": der(0x30, der(2, b"\0") + algorithm + der(4, inner) + extra)
    assert secret_scan.is_der_private_key(pkcs8(der(4, b"\7" * 32)))
    assert not secret_scan.is_der_private_key(pkcs8(b"\7" * 32))
    assert not secret_scan.is_der_private_key(pkcs8(der(0x30, der(2, b"\0"))))
    assert not secret_scan.is_der_private_key(pkcs8(der(4, b"\7" * 32), der(5, b"")))
    curve, point = der(0xA0, der(6, b"\x2a\x86\x48")), der(0xA1, der(3, b"\0" + b"\4" * 64))
    sec1 = lambda *rest: der(0x30, der(2, b"\1") + der(4, b"\7" * 16) + b"".join(rest))
    assert all(secret_scan.is_der_private_key(sec1(*x)) for x in ((), (curve,), (point,), (curve, point)))
    assert not any(secret_scan.is_der_private_key(sec1(*x)) for x in ((point, curve), (der(5, b""),), (der(0xA0, b"\1\2"),), (der(0xA1, der(4, b"\0")),)))


def test_the_shortest_key_is_found():
    key = der(0x30, der(2, b"\1") + der(4, b"\7" * 16))
    assert len(key) == 23 and "key64" in kinds(f"x {b64(key)} y") and "keyhex" in kinds(f"x {key.hex().upper()} y")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_a_block_is_read_alone(spark, kind):
    docs = spark.createDataFrame([(k, f"document {k} has words " * (k % 5)) for k in range(40)], "doc_id long, text string")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/blocks-{kind}"
    token_files.write_token_files(docs.coalesce(1), P.path("byte_bpe_50k.json"), folder, kind=kind, block_ids=50, chunk_ids=170)
    whole = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])])
    at, blocks = 0, 0
    for row in sorted((r.asDict() for r in spark.read.parquet(folder).collect()), key=lambda r: (r["part"], r["chunk"])):
        n = -(-row["n_ids"] // 50)
        assert len(np.frombuffer(row["plane_ends"], "<i8")) == n * (4 if kind == "byte" else 32)
        for k in reversed(range(n)):
            assert (token_files.block_ids_of(row, k) == whole[at + 50 * k : at + min(50 * k + 50, row["n_ids"])]).all()
        at, blocks = at + row["n_ids"], blocks + n
    assert at == len(whole) and blocks > 5


def test_counts_of_other_scripts_take_the_shortcut():
    path = P.path("byte_bpe_50k.json")
    library, counter = tokenize._library(path), tokenize.Counter(path, tokenize.whole_tokens(path))
    rnd = np.random.default_rng(3)
    letters = list("aZ é’—中文字кирил'st \n\t  ١٢😀 ǹﬁ \x85İ<|#")
    for _ in range(500):
        text = "".join(rnd.choice(letters, rnd.integers(0, 60)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False))
    assert len(counter.spelled) > 100


def test_long_texts_are_cut_where_both_patterns_cut(monkeypatch):
    monkeypatch.setattr(tokenize, "PIECE", 12)
    text = "It's  a long text,\nof words and 12 numbers\n\nand lines é’ 中文 that go on " * 5
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, encoder = tokenize._library(P.path(name)), tokenize.Encoder(P.path(name))
        assert len(tokenize.pieces(text)) > 10 and "".join(tokenize.pieces(text)) == text
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_the_table_of_answers_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_ENTRIES", 20)
    memo = tokenize._Memo(len, {"fixed": -1})
    assert [memo["w" * (k % 37)] for k in range(500)] == [k % 37 for k in range(500)] and memo["fixed"] == -1
    assert len(memo) <= 10 and len(memo.older) <= 10


def test_features_belong_to_their_own_rows():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "label": [1, 0, 0, 1], "text": ["a", "", "", "b. c"]})
    got = next(toxicity._features(iter([batch])))
    assert [len(x.as_py()) // 4 for x in got["slots"]] == [1, 0, 0, 2]
    assert np.frombuffer(got["vals"][3].as_py(), "<f4").tolist() == [0.0, 1.0]


def test_scores_are_the_noisy_or_of_their_sentences(spark):
    docs, labels = labelled(spark, 300, 3)
    model = toxicity.train(docs, labels)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["", "...", "one scum! \n two", "é ü. É"]
    slot = lambda word: int(T.word_hashes(one(word), np.array([0]), np.array([len(word.encode())]), lower=True)[0] >> np.uint64(64 - toxicity.BITS))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, model).collect()}
    for n, text in enumerate(texts):
        clean, spans, at = 1.0, 0, 0
        for sentence in re.split(r"[.!?\n]", text):
            words = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", sentence)
            if words:
                p = 1 / (1 + math.exp(-(sum(float(model.weights[slot(w)]) for w in words) + model.bias)))
                clean *= 1 - p
                spans += p >= toxicity.THRESHOLD
            at += len(sentence) + 1
        assert got[n]["score"] == pytest.approx(1 - clean, abs=1e-9) and len(got[n]["offending"]) == spans


def test_held_out_recall_and_precision(spark):
    """On the given labels, some of which no text explains: what the fitted model catches of the fold it never saw."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    named = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    truth = {r["doc_id"]: r["toxic"] for r in named.select("doc_id", "toxic").collect()}
    held = [r for r in toxicity.score_toxicity(named.select("doc_id", "text"), model).collect() if r["held_out"] and truth[r["doc_id"]] is not None]
    caught = [r for r in held if r["predicted"]]
    recall = sum(truth[r["doc_id"]] for r in caught) / sum(truth[r["doc_id"]] for r in held)
    precision = sum(truth[r["doc_id"]] for r in caught) / len(caught)
    print(f"held-out recall {recall:.3f}, precision {precision:.3f} of {len(held)}")
    assert recall > 0.5 and precision > 0.9


def test_character_ngrams_count_characters():
    for text in ("Grün é", "abcd", "東京東京東", "abc", ""):
        chunk = one(text)
        slots, first, last = linear.char_ngrams(chunk, 4, 13)
        assert (first[0], last[0]) == (0, max(0, len(text) - 3)) and (not text or len(slots) == max(0, len(text) - 3))
    a, b = (linear.char_ngrams(one(t), 4, 13)[0].tolist() for t in ("東京東京東京", "東京東京"))
    assert a[0] == a[2] == b[0]
    both = next(T.chunks(pa.array(["x東京", "GRÜN grün", None, "y"], pa.string())))
    slots, first, last = linear.char_ngrams(both, 4, 13)
    assert (last - first).tolist() == [0, 6, 0, 0]
    assert slots[first[1] : last[1]].tolist() == linear.char_ngrams(one("GRÜN grün"), 4, 13)[0].tolist()


def test_quality_with_clashing_columns_and_no_rows(spark):
    docs, labels = labelled(spark, 150)
    model = quality.train(docs, labels)
    assert len(quality.apply_rules(H.edge_docs(spark), model).collect()) == len(H.edge_rows())
    assert quality.train(H.empty_docs(spark), labels) is None


def test_slices_of_a_long_text_are_its_windows():
    for text in ("Abracadabra", "x" * 40 + "é" * 30, ""):
        chunk = one(text)
        want, _ = C.window_keys(chunk, 4)
        got = [k for keys, _ in C.window_slices(chunk, 4, 7) for k in keys.tolist()]
        assert got == want.tolist()


def test_hashes_do_not_depend_on_slices(monkeypatch):
    chunk = one("some words of Many lengths, a b cc " * 20)
    bounds = T.word_bounds(chunk, T.NOT_SPACE)
    want = T.word_hashes(chunk, *bounds, lower=True)
    monkeypatch.setattr(T, "CHUNK_BYTES", 9)
    assert (T.word_hashes(chunk, *bounds, lower=True) == want).all()


def test_deeper_contexts_shorten_the_code(spark):
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list("abcde"), 6)) for _ in range(60)]
    docs = spark.createDataFrame([(k, " ".join(rnd.choice(words, 60))) for k in range(200)], "doc_id long, text string")
    bits = {}
    for depth in (2, 4, 6):
        held = [r for r in C.score_texts(docs, depth).collect() if r["held_out"]]
        bits[depth] = sum(r["bits_per_byte"] for r in held) / len(held)
    assert bits[6] < bits[4] < bits[2] and zlib.crc32(b"0") % 7 != 2


def test_contamination_is_judged_row_by_row(spark):
    item = " ".join(f"bench{k}" for k in range(20))
    table = [(None, item, 1), (None, "clean words only", 2), (5, item, 3), (5, "clean words only", 4), (5, None, 5)]
    docs = spark.createDataFrame(table, "doc_id long, text string, _bad int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (1 << 20, 10):
        assert sorted(r["_bad"] for r in fm_index.drop_contaminated(docs, items, max_query_bytes=limit).collect()) == [2, 4, 5]


def test_reply_pairs_with_nulls_and_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id int"
    turns = spark.createDataFrame([(4, 1, "user", "q", 0), (4, 2, "assistant", "a", 0), (5, None, None, None, 0), (5, 3, "assistant", None, 0), (None, 1, "user", "x", 0)], schema)
    got = {r["pair_id"]: r for r in preferences.format_pairs(preferences.last_reply_pairs(turns)).collect()}
    assert set(got) == {4, 5, None} and got[4]["rejected"] == "<|assistant|>\n<|end|>\n" and got[5]["rejected"] == "<|assistant|>\na<|end|>\n"
    assert got[None]["prompt"] == got[None]["prompt"] and got[None]["chosen"] == ""
    assert preferences.format_pairs(preferences.last_reply_pairs(spark.createDataFrame([], schema))).count() == 0


def test_signed_tokens_need_an_algorithm():
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert secret_scan.is_signed_token(f"{part({'alg': 'HS256'})}.{part({'a': 1})}.c2ln") and not secret_scan.is_signed_token(f"{part({'typ': 'x'})}.{part({})}.c2ln")
