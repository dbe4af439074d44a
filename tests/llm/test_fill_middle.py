import hashlib
import random

import numpy as np
import pytest
from voxelloom.llm import fill_middle as M

from tests.llm import helpers as H


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc, text, seed=1, percent=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return (doc, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < first else "psm"
    return (doc, n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


NAMES = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_equals_plain_python(spark):
    rnd = random.Random(1)
    letters = list("ab <>PSM\né東\U0001f600\x00́") + ["<P>", "<S", "<M", "<<"]
    rows = [(i, "".join(rnd.choices(letters, k=rnd.randint(0, 30))), 7) for i in range(800)] + H.edge_rows() + [(801, "<S>", 7), (802, "<", 7), (803, "東" * 70_000 + "abc" * 30_000, 7)]
    got = H.rows(M.digest(M.rearrange(spark.createDataFrame(rows, "doc_id long, text string, form long"))), *NAMES)
    assert got == sorted((brute(d, t) for d, t, _ in rows), key=lambda t: [(x is not None, x) for x in t])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.digest(M.rearrange(H.empty_docs(spark))).count() == 0


def test_every_text_drawn_and_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i)), 1) for i in range(60)]
    out = M.rearrange(spark.createDataFrame(rows, "doc_id long, text string, n long"), unit="word", percent=100, suffix_first_percent=50)
    for r in out.withColumn("again", M.restored(out["output"], out["form"])).collect():
        assert r["again"] == r["text"] and r["n"] == (r["doc_id"] if r["doc_id"] else 0)
        assert (r["form"] == "plain") == (r["text"] == "")
        prefix = r["output"].split("<P>")[1].split("<S>" if r["form"] == "psm" else "<M>")[0] if r["text"] else ""
        assert prefix == "".join(f"w{k} " for k in range(r["prefix_units"] or 0))[: len(prefix)] and prefix.count("w") == (r["prefix_units"] or 0)


@pytest.mark.parametrize(("values", "kind"), [(np.arange(3, 60_003), M.RUN), (np.arange(0, 60_000, 7), M.BITMAP), (np.array([5]), M.ARRAY), (np.arange(0, 60_000, 90), M.ARRAY), (np.arange(65_536), M.RUN)])
def test_containers_select(values, kind):
    box = M.Container(values)
    assert box.kind == kind
    assert [box.select(k) for k in range(0, len(values), 131)] == values[::131].tolist() and box.select(len(values) - 1) == values[-1]


def test_sets_select_across_containers():
    rng = np.random.default_rng(2)
    offsets = np.unique(np.concatenate([np.arange(70_000), rng.integers(0, 1 << 20, 3000), 400_000 + np.flatnonzero(rng.random(200_000) < 0.4)]))
    own = M.BoundarySet(offsets)
    assert {c.kind for c in own.containers} == {M.ARRAY, M.BITMAP, M.RUN}
    assert [own.select(k) for k in range(0, len(offsets), 97)] == offsets[::97].tolist()
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            own.select(k)
