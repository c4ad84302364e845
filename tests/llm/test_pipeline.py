"""The pipeline's stages one by one and together, and the registered queries."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tarnfold.llm import catalog, packing, pii, quality, simhash
from tests.llm.cases import ROWS, SF, docs, read
from tests.llm.test_near_duplicates import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Documents of a larger table, and what each stage made of them."""
    folder, out = tmp_path_factory.mktemp("stages"), [read(spark, "documents")]
    for name, stage in P.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontaminate", "personal_data", "pack"]
    for df in stages[1:5]:
        assert df.dtypes == stages[0].dtypes
    counts = [df.count() for df in stages[:5]]
    assert counts == sorted(counts, reverse=True) and counts[4] == counts[3] > 0.5 * counts[0]


def test_quality_stage_follows_the_scores(spark, stages):
    stats = quality.statistics(stages[0], keep_cols=("doc_id",))
    scores = {r.doc_id: r.score for r in quality.score_quality(stats, quality.train_quality(stats, read(spark, "labels"))).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_one_of_each_component(stages):
    """Texts link if their fingerprints are in one component of 8 bits and their shingle sets have a Jaccard similarity of 0.8 or more."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def similar(a, b):
        return len(a & b) >= 0.8 * len(a | b)

    rows = sorted((r.doc_id, brute_fingerprint(r.text, 5), shingles(r.text)) for r in stages[1].select("doc_id", "text").collect())
    near = brute_components(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 8)
    root = brute_components(len(rows), lambda i, j: near[i] == near[j] and similar(rows[i][2], rows[j][2]))
    assert {r.doc_id for r in stages[2].collect()} == {rows[c][0] for c in set(root)}


def test_no_leak_stays_and_nothing_else_goes(spark, stages):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    items = [s for s in (shingles(r.text) for r in read(spark, "benchmark").collect()) if s]
    clean = {r.doc_id for r in stages[2].collect() if not any(len(s & shingles(r.text)) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in stages[3].collect()} == clean


def test_personal_data_is_masked(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[3:5])
    spans = {r.doc_id: r.pii_spans for r in pii.find_spans(stages[3]).collect()}
    for i, r in before.items():
        text, at = [], 0
        for s in spans[i]:
            if s.start >= at:
                text.append(f"{r.text[at:s.start]}[{s.kind}]")
            at = max(at, s.end)
        assert after[i].text == "".join(text) + r.text[at:] and after[i].n_chars == len(after[i].text)


def test_everything_left_is_packed(stages):
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(encoder.model.encode(r.text, add_special_tokens=False).ids) + 1 for r in stages[4].collect()}
    got = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    total = sum(want.values())
    assert got == want and stages[5].select("sequence_id").distinct().count() <= total / 2048 + 2


def test_stages_take_awkward_rows(spark):
    for df in (docs(spark), docs(spark, [])):
        for name, stage in P.STAGES:
            out = stage(spark, df, SF)
            assert name == "pack" or out.columns == df.columns
            n = out.count()
            assert n >= (len(ROWS) if name in ("personal_data", "pack") and df.count() else 0)


def test_run(spark, stages):
    out = P.run(spark, SF)
    assert out.columns == stages[5].columns
    assert out.agg(F.sum("length"), F.count("*")).first() == stages[5].agg(F.sum("length"), F.count("*")).first()


def test_catalog():
    queries, oracles = catalog.load()
    assert sorted(int(k[2:].split("_")[0]) for k in queries) == list(range(1, 14)) and set(oracles) <= set(queries)
    assert simhash.QUERIES.keys() <= queries.keys()


@pytest.mark.parametrize("name", ["op4_leaks", "op9_pii"])
def test_native_queries_equal_sql(spark, name):
    from workloads.check import compare, connect
    queries, oracles = catalog.load()
    verdict = compare(spark, connect(SF), name, queries[name], oracles[name], SF)[0]
    assert verdict.startswith("ok") and "EMPTY" not in verdict, verdict
