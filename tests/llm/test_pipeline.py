"""The pipeline, stage by stage, against brute force."""

from collections import Counter

import pytest

import corpus_pipeline

from .conftest import corpus
from .test_text_dedup import brute_components, brute_repeats, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = [r[:5] for r in corpus() if r[0] is not None and r[0] not in (40, 41)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = docs
        if name != "pattern_packing":
            assert docs.columns == COLUMNS
    get = lambda name: [tuple(r) for r in seen[name].collect()]

    kept = get("quality_rules")
    assert 0 < len(kept) < 95 and all(len(words(r[1])) >= 50 for r in kept)

    one = get("ngram_jaccard")
    assert sorted(r[0] for r in one) == sorted({root for _, _, root in brute_components(kept)})
    assert set(one) <= set(kept)

    short = get("substring_dedup")
    want = {i: (removed, text) for i, _, removed, text in brute_repeats(one, 13)}
    whole = {r[0]: r[1] for r in one}
    assert {r[0]: r[1] for r in short} == {i: text if removed else whole[i] for i, (removed, text) in want.items()}
    assert all(r[4] == len(r[1]) for r in short)

    mixed = Counter(r[0] for r in get("systematic_mixing"))
    assert max(mixed.values()) <= 2 and set(mixed) <= set(whole)
    assert sum(len(words(r[1])) for r in get("systematic_mixing")) == pytest.approx(1.5 * sum(len(words(r[1])) for r in short), rel=0.5)

    packed = seen["pattern_packing"].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    used = Counter()
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096


def test_run_gives_the_same(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    again = spark.read.parquet(f"{folder}/pattern_packing")
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert got.select(*key).exceptAll(again.select(*key)).count() == again.select(*key).exceptAll(got.select(*key)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_tables(spark, docs, empty, folder):
    """Null and repeated ids, clashing names, no rows: columns stay and nothing breaks."""
    for table in (docs, empty):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, folder).checkpoint()
            assert now.columns == table.columns, name
            assert all(r.tie is None or r.tie == f"x{r.doc_id}" == r._row for r in now.select("doc_id", "tie", "_row").collect()), name
        packed = corpus_pipeline.STAGES[-1][1](spark, now, folder)
        assert (packed.count() > 0) == (table is docs)
