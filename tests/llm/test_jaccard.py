import random

from voxelloom.llm import components, jaccard

from tests.llm import helpers as H


def brute(table, width, percent):
    """Sets, links and groups of (row, id, text); rows without an id take no part."""
    sets = []
    for _, text in table:
        w = H.SPACE_WORDS.findall(H.lowered(text))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(table)):
        for b in range(a):
            if table[a][0] is None or table[b][0] is None or not (sets[a] and sets[b]):
                continue
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (doc, _) in enumerate(table):
        if doc is not None:
            least[find(n)] = min(least.get(find(n), doc), doc)
    out = [(doc, len(sets[n]), least[find(n)] if doc is not None else None) for n, (doc, _) in enumerate(table)]
    return sorted(out, key=lambda t: [(x is not None, x) for x in t])


def found(df, width=3, percent=90):
    return H.rows(jaccard.near_duplicates(df, width, percent), "doc_id", "n_shingles", "component_id")


def copies(n, length, seed):
    """A base text and variants with a few words changed, dropped or added, over a small vocabulary, with a shared passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    passage = " ".join(rnd.choices(vocabulary, k=25))
    bases = [rnd.choices(vocabulary, k=length) for _ in range(3)]
    out = []
    for k in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)] if rnd.random() < 0.7 else []
        out.append((k, (passage + " " if k % 3 == 0 else "") + " ".join(words)))
    return out


def test_groups_match_brute_force(spark):
    for seed, (width, percent, length) in enumerate([(3, 90, 60), (5, 80, 40), (2, 60, 12), (1, 50, 5)]):
        table = copies(90, length, seed)
        df = spark.createDataFrame(table, "doc_id long, text string")
        assert found(df, width, percent) == brute(table, width, percent)


def test_exact_threshold_and_case(spark):
    nine = " ".join(f"a{k}" for k in range(21))  # 19 shingles; one word more at the end makes 20
    table = [(1, nine), (2, nine.upper() + " tail"), (3, "x y"), (4, "X  Y"), (5, "x y z"), (6, "x"), (7, "x\x0by")]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert found(df) == brute(table, 3, 90)
    assert dict((a, c) for a, _, c in found(df))[2] == 1  # 19 / 20


def test_edges(spark):
    table = [(d, t) for d, t, _ in H.edge_rows()]
    assert found(H.edge_docs(spark)) == brute(table, 3, 90)
    assert jaccard.near_duplicates(H.empty_docs(spark)).count() == 0


def test_filters_never_lose_a_pair():
    import numpy as np

    for a in range(1, 40):
        for b in range(1, 40):
            need = jaccard.least_overlap(a, b, 90)
            assert all((100 * c >= 90 * (a + b - c)) == (c >= need) for c in range(min(a, b) + 1))
    rng = np.random.default_rng(0)
    x, y = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(2))
    y[:280] = x[:280]
    p = jaccard._parities(np.repeat([0, 1], 300), np.concatenate([x, y]), 2).view(np.uint64)
    assert sum(int(v).bit_count() for v in p[0] ^ p[1]) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_wide_sketches_bound_the_difference_and_tell_large_sets_apart():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 9000).astype(np.uint64)
    sizes = [0, 200, 256, 257, 2000, 2100, 2000, 5000]
    sets = [np.sort(pool[k * 100 : k * 100 + n]) for k, n in enumerate(sizes)]
    sets[6] = np.sort(pool[1400:3400])  # shares 1000 of 2000 with the fifth
    wide = jaccard.wide_sketches(np.repeat(np.arange(8), sizes), np.concatenate(sets), np.array(sizes)).to_pylist()
    assert [8 * len(w) for w in wide] == [0, 0, 0, 512, 2048, 4096, 2048, 8192]
    for x, a in zip(sets, wide, strict=True):
        assert jaccard.slots_that_differ(a, a) == 0
        for y, b in zip(sets, wide, strict=True):
            assert jaccard.slots_that_differ(a, b) == jaccard.slots_that_differ(b, a) <= len(set(x.tolist()) ^ set(y.tolist()))
    assert jaccard.slots_that_differ(wide[4], wide[6]) > 4000 - 2 * jaccard.least_overlap(2000, 2000, 80)


def test_long_texts_that_share_a_passage_or_nearly_all(spark):
    """Sets beyond the short sketch: shared halves are no links, nine in ten words are, whatever the text repeats."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(6000)]
    base = [rng.choice(words) for _ in range(1500)]
    table = [(k, " ".join(base[:750] + [rng.choice(words) for _ in range(750)])) for k in range(12)]
    table += [(20 + k, " ".join(base[: 1500 - 20 * k])) for k in range(5)] + [(30, "again " * 50_000 + "end"), (31, "again " * 40_000 + "end")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert found(df, 5, 80) == brute(table, 5, 80)


def rank_table(grams_of_classes, bits):
    """The table of a corpus in one task, through the form in which parts travel."""
    import numpy as np
    import pyarrow as pa

    cells, counts = np.unique(np.concatenate([g >> np.uint64(64 - bits) for g in grams_of_classes]).astype(np.int64), return_counts=True)
    packed = list(jaccard._packed_counts(cells, counts, bits))
    half = [jaccard._packed_counts(cells, (counts + k) // 2, bits) for k in (0, 1)]  # two tasks that share every cell
    parts = sorted((k, x) for part in half for k, x in part)
    out = np.zeros((1 << (bits - jaccard.BLOCK_BITS), 1 << (jaccard.BLOCK_BITS - 1)), np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "counts"])
    for done in jaccard._ranked(float(counts.sum()) / (1 << bits))(iter([batch])):
        for k, x in zip(done["block"].to_pylist(), done["ranks"].to_pylist(), strict=True):
            out[k] = np.frombuffer(x, np.uint8)
    assert all((jaccard._unpacked_counts(x)[0] == cells[cells >> jaccard.BLOCK_BITS == k] & ((1 << jaccard.BLOCK_BITS) - 1)).all() for k, x in packed)
    return out.reshape(-1)


def test_ranks_order_shingles_and_leave_out_those_of_one_class():
    """With about a cell a shingle few prefix rows have no partner; exact counts would leave hardly fewer that have one."""
    import numpy as np

    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 150).astype(np.uint64) * np.uint64(2), common[(rng.random(60) ** 3 * 3000).astype(int)]])) for _ in range(2500)]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    names, exact = np.unique(grams, return_counts=True)
    count = dict(zip(names.tolist(), exact.tolist(), strict=True))
    table = rank_table(sets, 20)
    ranks = jaccard.ranks_of(table, grams)
    assert all(r > 0 for r, g in zip(ranks.tolist(), grams.tolist(), strict=True) if count[g] > 1)

    def shared(found, tokens):
        both, n = np.unique(tokens, return_counts=True)
        return int(n[n > 1].sum()), len(tokens)

    _, tokens, place, _ = jaccard.prefix_rows(table, rows, grams, sizes, np.ones(len(sets), bool), 80)
    with_partner, sent = shared(rows, tokens)
    in_order = sorted(zip(rows.tolist(), (count[g] for g in grams.tolist()), grams.tolist(), strict=True))
    at, prefix = {}, []
    for r, n, g in in_order:
        k = at[r] = at.get(r, -1) + 1
        if k < sizes[r] - -(-80 * sizes[r] // 100) + max(1, sizes[r] // 50) and n > 1:
            prefix.append(g)
    best, _ = shared(None, np.array(prefix, np.uint64))
    assert sent < 0.2 * 0.22 * len(grams) and with_partner <= 1.5 * best + 20


def test_rows_that_differ_elsewhere_keep_one_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(1, "said more than once in other languages", x) for x in "abcdef"], "doc_id long, text string, lang string")
    assert len({jaccard.keep_one(docs.repartition(n)).first()["lang"] for n in (1, 3, 6)}) == 1


def test_no_step_is_left_behind(spark):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found(spark.createDataFrame(copies(40, 30, 1), "doc_id long, text string"))
    left = sorted(p.name.split("-")[0] for p in set(folder.iterdir()) - before)
    assert left == ["classes", "profile", "stars"] or left == ["classes", "links", "profile"]  # what the result reads


def test_keep_one(spark):
    base = " ".join(f"q{k}" for k in range(80))
    docs = spark.createDataFrame([(4, base, 1), (2, base + " end", 2), (9, "other text of its own here", 3), (None, base, 4), (7, None, 5)], "doc_id long, text string, component_id int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["component_id"]) for r in kept.collect()} == {(2, 2), (9, 3), (None, 4), (7, 5)}


def test_keep_one_judges_each_row_of_a_repeated_id(spark):
    base = " ".join(f"q{k}" for k in range(80))
    other = " ".join(f"r{k}" for k in range(80))
    rows = [(1, base), (5, base + " end"), (5, other), (5, other), (5, other + " end"), (6, other), (8, "said twice"), (8, "said twice"), (None, other), (None, other), (9, None), (9, None)]
    docs = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(rows)], "doc_id long, text string, stays int")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = H.rows(kept, "doc_id", "text")
    of_five = [t for d, t in got if d == 5]
    assert len(of_five) == 1 and of_five[0] in (other, other + " end")
    assert [r for r in got if r[0] != 5] == [(None, other), (None, other), (1, base), (8, "said twice"), (9, None), (9, None)]


def test_components_of_long_paths_and_stars(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == {k: v for k, v in label.items() if k != v}
