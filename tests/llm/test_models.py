"""The two classifiers and the language model."""

import collections
import math
import random
import re
import zlib

import numpy as np
from voxelloom.llm import context_tree as C
from voxelloom.llm import quality, toxicity

from tests.llm import helpers as H

BAD = ("scum", "moron", "idiot")


def labelled(spark, n=600, seed=1):
    """Clean words with, in the toxic rows, one bad word in one sentence; poor rows shout."""
    rnd = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        sentences = [" ".join(rnd.choices([f"word{x}" for x in range(300)], k=12)) for _ in range(6)]
        toxic, poor = int(rnd.random() < 0.25), int(rnd.random() < 0.25)
        if toxic:
            at = rnd.randrange(6)
            sentences[at] += " " + rnd.choice(BAD)
        text = ". ".join(sentences) + "."
        docs.append((k, text.upper().replace(" ", "!! ") if poor else text))
        labels.append((k, 1 - poor, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (10**6, None, None), (0, labels[0][1], labels[0][2])], "doc_id long, quality int, toxic int")


def test_toxicity_learns_from_bags_and_finds_the_sentence(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.dropna().collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in scored)
    located = [(r, s) for r in held if r["predicted"] and truth[r["doc_id"]] for s in r["offending"]]
    assert len(located) > 20
    assert all(any(w in texts[r["doc_id"]][s["start"] : s["end"]].lower() for w in BAD) for r, s in located)


def test_held_out_labels_change_nothing(spark):
    docs, labels = labelled(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 200)
    model = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(H.edge_docs(spark), model).collect()
    assert len(got) == len(H.edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(H.empty_docs(spark), model).count() == 0
    assert toxicity.train(H.empty_docs(spark), labels) is None
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    kept = toxicity.drop_toxic(H.edge_docs(spark), model)
    assert kept.columns == H.edge_docs(spark).columns and kept.count() == len(H.edge_rows())


def base_counts(text):
    w = H.SPACE_WORDS.findall(text or "")
    triples = collections.defaultdict(list)
    for k in range(len(w) - 2):
        triples[tuple(w[k : k + 3])].append(k)
    covered = {k + n for at in triples.values() if len(at) > 1 for k in at for n in range(3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if H.SPACE_WORDS.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)


def test_base_rules_match_brute_force(spark):
    rnd = random.Random(7)
    table = [(k, "".join(rnd.choices(["a ", "b ", "é ", "\n", "c#", "<x>", "a b c ", "\x0b", " "], k=rnd.randint(0, 120)))) for k in range(200)]
    table += [(1000 + n, t) for n, (_, t, _) in enumerate(H.edge_rows())]
    got = {r["doc_id"]: r for r in quality.apply_rules(spark.createDataFrame(table, "doc_id long, text string"), None).collect()}
    for doc, text in table:
        r, want = got[doc], base_counts(text)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r["kept"] == (not r["base_failed"])


def test_quality_model_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    fit, rest = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0").dropna()
    truth = {r["doc_id"]: r["quality"] for r in rest.collect()}
    scored = [r for r in quality.apply_rules(docs, quality.train(docs, fit)).collect() if r["doc_id"] in truth]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in scored]) > 0.97
    assert np.mean([r["kept"] for r in scored if truth[r["doc_id"]]]) > 0.97
    bins = [(r["score"], truth[r["doc_id"]]) for r in scored]
    assert abs(np.mean([p for p, _ in bins]) - np.mean([y for _, y in bins])) < 0.05
    assert quality.apply_rules(H.empty_docs(spark), None).count() == 0


def brute_ctw(table, depth):
    """Counts and mixtures straight from the definition, one decision at a time."""
    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(text):
        s = [0] * depth + list(H.lowered(text).encode()) + [0]
        for i in range(depth, len(s)):
            context, place = tuple(s[i - d] for d in range(1, depth + 1)), 1
            for k in range(7, -1, -1):
                bit = s[i] >> k & 1
                yield context, place, bit
                place = place * 2 + bit

    trains = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    for doc, text in table:
        if trains(doc):
            for context, place, bit in decisions(text):
                for d in range(depth + 1):
                    counts[context[:d], place][bit] += 1
    children = collections.defaultdict(set)
    for context, place in counts:
        if context:
            children[context[:-1], place].add(context)

    def kt(node):
        a, b = counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(node):
        if node not in memo:
            below = sum(weighted((c, node[1])) for c in children[node])
            memo[node] = kt(node) if len(node[0]) == depth else float(np.logaddexp(math.log(0.5) + kt(node), math.log(0.5) + below))
        return memo[node]

    def probability(context, place, bit, d=0):
        node = context[:d], place
        n = counts.get(node, (0, 0))
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        share = math.exp(math.log(0.5) + kt(node) - weighted(node))
        return share * own + (1 - share) * probability(context, place, bit, d + 1)

    tokens = lambda t: [*H.SPACE_WORDS.findall(H.lowered(t)), None]
    seen = collections.Counter(w for d, t in table if trains(d) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return [(d, not trains(d), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t)), sum(math.log10(probability(*x)) for x in decisions(t))) for d, t in table]


def test_context_tree_matches_its_definition(spark):
    table = [(k, t) for k, t in enumerate(["Abracadabra abra", "", None, "é ça où", "abra cad", "bra\x00bra", "aaaa aaaa aaaa", "the end", "The End.", "x"])]
    for depth in (2, 4):
        got = sorted(tuple(r)[:7] for r in C.score_texts(spark.createDataFrame(table, "doc_id long, text string"), depth).collect())
        for a, b in zip(got, brute_ctw(table, depth), strict=True):
            assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9)


def test_context_tree_edges(spark):
    got = C.score_texts(H.edge_docs(spark)).collect()
    assert len(got) == len(H.edge_rows()) and all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in got)
    assert C.score_texts(H.empty_docs(spark)).count() == 0


def test_context_tree_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    seen = rng.integers(97, 100, (400, 5)).astype(np.int64)
    seen[:, :2] = (98, 97)
    every = np.stack([np.concatenate([seen[0, :4], [x]]) for x in range(256)])
    pack = lambda m: (m << np.array([32, 24, 16, 8, 0])).sum(1)
    keys, n = np.unique(pack(seen), return_counts=True)
    all_keys = np.unique(np.concatenate([keys, pack(every)]))
    counts = np.zeros(len(all_keys))
    counts[np.searchsorted(all_keys, keys)] = n
    total = np.zeros(len(all_keys))
    for _, _, p, *_ in C.subtrees(all_keys, counts, 4):
        total += np.log(p)
    assert abs(np.exp(total[np.searchsorted(all_keys, pack(every))]).sum() - 1) < 1e-9


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2, 10, 1e3, 1e9])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
