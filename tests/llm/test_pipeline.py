import corpus_pipeline as cp
import test_decontam
import test_near_dedup
import test_pii

from alignspark.llm import quality, tokens
from alignspark.llm.common import materialize, table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "benchmark decontamination", "personal data", "best-fit packing"]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    for _, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = materialize(stage(spark, docs, sf), "stage")
        if stage is cp.packed:
            sp = tokens._processor(tokens.model_path())
            assert out.groupBy().sum("n_tokens").first()[0] == sum(len(sp.encode(t)) for t in before.values())
            continue
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        if stage is cp.good_quality:
            model = quality.fit_quality(docs, table(spark, sf, "labels"))
            assert set(after) == {r.doc_id for r in quality.score_quality(docs, model).collect() if r.predicted}
        elif stage is cp.near_duplicates:
            assert set(after) == {i for i, (_, low) in test_near_dedup.plain(list(before.items()), 5).items() if low == i}
        elif stage is cp.decontamination:
            found = test_decontam.plain(list(before.items()), items)
            assert set(after) == {i for i in before if not found[i][4]}
        elif stage is cp.personal_data:
            assert set(after) == set(before)
            assert all(not test_pii.plain(t) for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not test_pii.plain(t) and "card" not in t.lower() and "iban" not in t.lower())
        docs = out


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.count() > 0 and "bin_id" in out.columns


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf).count() == 0
