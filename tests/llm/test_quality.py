import math
import random
import zlib

import pytest

from alignspark.llm import quality
from alignspark.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs.join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", "text"), model).join(labels, "doc_id").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98
    # calibrated: in each tenth of the scores, their mean is near the share of label 1, weighed by its rows
    tenths = {}
    for r in rows:
        tenths.setdefault(min(int(r.score * 10), 9), []).append((r.score, r.quality))
    assert sum(abs(sum(s for s, _ in x) - sum(q for _, q in x)) for x in tenths.values()) / len(rows) < 0.03
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in rows[:200]:
        assert r.score == pytest.approx(plain_score(model, text[r.doc_id]), abs=1e-12)


def plain_score(model, text):
    """The score by its definition: two compressors, blocks of 2 KiB, a weighted difference, the logistic curve."""
    import zstandard

    raw, total = (text or "").encode(), []
    for content in (model.bad, model.good):
        z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        total.append(sum(len(z.compress(raw[i : i + 2048])) for i in range(0, max(len(raw), 1), 2048)))
    n = max(len(raw), 1)
    bias, wb, wg = model.weights
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + wb * total[0] / n + wg * total[1] / n))))


def test_training_rows_are_bounded_and_not_held_out(spark):
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(500)] + [(1, None, 0), (2, 7, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.training_rows(labels, 40).collect()
    assert len(rows) == 80 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert len({r.doc_id for r in rows}) == 80 and {r.quality for r in rows} == {0, 1}


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0), (3, 1), (4, 0)]])
def test_edges(spark, labelled):
    rng = random.Random(1)
    texts = [None, "", "x" * 200_000, " ".join(rng.choice(["a", "bc", "d"]) for _ in range(50)), "😀 é"]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in enumerate(texts)] + [(3, texts[3], "s", 0.5)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(a, b, 0) for a, b in labelled], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = quality.score_quality(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score_quality(docs.limit(0), model).count() == 0
