import corpus_pipeline as P
import pytest
from voxelloom.llm import secret_scan, toxicity
from voxelloom.llm.storage import written

from tests.llm import helpers as H
from tests.llm.test_fm_index import brute as brute_contamination
from tests.llm.test_jaccard import brute as brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the output of each stage, written between them as the pipeline does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    secret = spark.createDataFrame([(10_001, 'a clean text of words with token = "abcdefghijklmnop" in it ' * 3, "en", "s", 1), (10_002, None, "en", "s", None)], docs.schema)
    docs = written(docs.unionByName(secret), "docs")
    out = {"input": docs}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out[name] = docs
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "secret_scans", "packing"]
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns and stages[name].dtypes == stages["input"].dtypes


def test_toxic_documents_go(spark, stages):
    model = toxicity.train(stages["input"], spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r["doc_id"] for r in toxicity.score_toxicity(stages["input"], model).collect() if not r["predicted"]}
    assert set(texts(stages["toxicity"])) == keep and 100 < len(keep) < stages["input"].count()


def test_one_of_each_group_stays(stages):
    before = texts(stages["toxicity"])
    want = {d for d, _, c in brute_groups(list(before.items()), 5, 80) if d == c}
    assert texts(stages["ngram_jaccard"]) == {d: before[d] for d in want} and len(want) < len(before)


def test_contaminated_documents_go(spark, stages):
    before = texts(stages["ngram_jaccard"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination(list(before.items()), items) if r[5]}
    assert texts(stages["decontamination"]) == {d: t for d, t in before.items() if d not in bad}


def test_secrets_are_masked(stages):
    before, after = texts(stages["decontamination"]), texts(stages["secret_scans"])
    assert before.keys() == after.keys()
    for d, text in before.items():
        if text is None or not secret_scan.scan_text(text):
            assert after[d] == text
        else:
            assert "<secret>" in after[d] and not secret_scan.scan_text(after[d])
    assert "<secret>" in after[10_001]
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in stages["secret_scans"].collect())


def test_every_document_is_packed(stages):
    tokens = {}
    for r in stages["packing"].collect():
        tokens.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert {d for d, _ in tokens} == set(texts(stages["secret_scans"]))
    for (_, n), parts in tokens.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n


def test_run_gives_the_last_stage(spark, stages):
    docs = {r["doc_id"] for r in P.run(spark, SF).collect()}
    assert docs == {d for d in texts(stages["secret_scans"]) if d < 10_000}


def test_stages_take_an_empty_table(spark):
    docs = H.empty_docs(spark)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
