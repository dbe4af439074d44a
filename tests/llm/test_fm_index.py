import hashlib
import random

import numpy as np
import pytest
from voxelloom.llm import fm_index as M

from tests.llm import helpers as H


def words(text):
    return H.ALNUM_WORDS.findall(H.lowered(text))


def brute(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w and item is not None else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        names = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(docs, items, **options):
    return H.rows(M.digest(M.find_contamination(docs, items, **options)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def random_tables(seed):
    rnd = random.Random(seed)
    letters = ["a", "B", "c-d", "é", "e"]
    items = [(k * 7, " ".join(rnd.choices(letters, k=rnd.choice([1, 4, 13, 14, 40])))) for k in range(6)]
    docs = [(k, " ".join(rnd.choices([*letters, "zz"], k=rnd.randint(0, 60))) + " " + rnd.choice(items)[1]) for k in range(40)]
    return docs, [*items, (99, None), (None, "a a a"), (100, ""), items[0]]


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(spark, seed):
    docs, items = random_tables(seed)
    assert found(*tables(spark, docs, items)) == brute(docs, items)
    assert found(*tables(spark, docs, items), shard_words=20) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = random_tables(9)
    docs = [*docs, docs[0], (None, docs[1][1])]
    assert found(*tables(spark, docs, items), max_query_bytes=100) == brute(docs, items)


def test_edges(spark):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "東京 word grün")], "item_id long, text string")
    rows = [(d, t) for d, t, _ in H.edge_rows()]
    assert found(H.edge_docs(spark), items) == brute(rows, [(1, "quick brown fox"), (2, "東京 word grün")])
    assert M.find_contamination(H.empty_docs(spark), items).count() == 0
    assert {r["n_hit"] for r in M.find_contamination(H.edge_docs(spark), items.limit(0)).collect()} == {0}


def test_index_finds_every_place():
    rng = np.random.default_rng(4)
    runs = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(40)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = M.FMIndex(text, 4, every=5)
    for n in (1, 2, 3, 6):
        window = rng.integers(1, 5, n)
        low, high = index.search(window[None, :].astype(np.int64), np.array([n]))
        got = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert got == [k for k in range(len(text) - n + 1) if (text[k : k + n] == window).all()]


def test_spans_cut_out_the_hits(spark):
    item = " ".join(f"b{k}" for k in range(20))
    text = f"É start, {item} and {item.upper()} end"
    r = M.find_contamination(*tables(spark, [(1, text)], [(5, item)])).first()
    assert [text[s["start"] : s["end"]] for s in r["spans"]] == [item, item.upper()] and r["n_hit"] == 40


def test_drop_contaminated_keeps_the_rest(spark):
    item = " ".join(f"b{k}" for k in range(20))
    docs, items = tables(spark, [(1, item), (2, "clean"), (3, None), (None, "x"), (4, item + " w" * 500)], [(5, item)])
    assert H.rows(M.drop_contaminated(docs, items), "doc_id") == [(None,), (2,), (3,), (4,)]


def test_drop_contaminated_judges_each_row(spark):
    item = " ".join(f"b{k}" for k in range(20))
    docs, items = tables(spark, [(None, item), (None, "clean"), (None, None), (7, item), (7, "clean"), (7, "clean"), (8, item), (8, item)], [(5, item)])
    for options in ({}, {"max_query_bytes": 10}):
        assert H.rows(M.drop_contaminated(docs, items, **options), "doc_id", "text") == [(None, None), (None, "clean"), (7, "clean"), (7, "clean")]
