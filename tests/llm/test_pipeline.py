"""The pipeline: every stage's decisions take effect on what its predecessor kept."""

import corpus_pipeline
from airsignal.llm import bpe, exact_dedup, pipeline, simhash, toxicity
from airsignal.llm.common import crc_mod, saved, table
from airsignal.llm.queries import vocabulary_path
from airsignal.session import checkpoint_root
from tests.conftest import SF, SF01
from tests.llm.conftest import EDGES


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_one_by_one(spark):
    docs, columns, sizes = table(spark, SF01, "documents"), None, []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, docs, SF01), "test-stage")
        sizes.append(after.count())
        if name == "toxicity":
            model = toxicity.fit(docs, table(spark, SF01, "labels").where(crc_mod("doc_id", 5) != 0))
            assert ids(after) == ids(toxicity.score(docs, model).where("score < 0.5"))
        elif name == "exact dedup":
            assert ids(after) == ids(exact_dedup.exact_duplicates(docs).where("kept"))
        elif name == "simhash near-dedup":
            assert ids(after) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        elif name == "mixing":
            found = {r.doc_id: r for r in pipeline.rates(spark, docs, SF01).collect()}
            n = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert max(n.values()) == 1 and all(0 <= r.rate <= 1 and (n.get(i) == 1 or r.rate < 1) for i, r in found.items())
            share = sum(r.rate * r.tokens for r in found.values() if r.domain == "low") / sum(r.rate * r.tokens for r in found.values())
            assert share < 1.2 * pipeline.TARGETS["low"] and all(i in n for i, r in found.items() if r.domain != "low" and r.posterior > 0.999)
        else:
            assert ids(after) == ids(docs) and {"n_tokens", "ids_sha256"} <= set(after.columns)
            break
        assert after.columns == columns
        docs = after
    assert sizes[0] < 1000 and sizes[1] < sizes[0] and sizes[2] <= sizes[1]


def test_run_and_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "bpe"]
    root = checkpoint_root(spark)
    listed = lambda: {f.getPath().getName() for f in fs.listStatus(path)}
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = listed()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    left = [f for f in listed() - before if f.startswith("airsignal-")]
    assert len(left) == 1 and "stage-bpe" in left[0]  # only the result is left of a run


def test_edge_rows_pass_every_stage(spark, edges, empty):
    for docs in (edges, empty):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs_after = saved(stage(spark, docs, SF), "test-edges")
            assert docs_after.count() <= 2 * n + 1
            if name != "bpe":
                assert docs_after.columns == docs.columns
                docs = docs_after
    assert len(EDGES) > 0


def test_bpe_of_the_result(spark):
    docs = table(spark, SF, "documents").limit(20)
    assert bpe.encode_digest(docs, vocabulary_path()).count() == 20
