"""The pipeline's stages against what they should keep."""

import random

import pytest

import corpus_pipeline
from pleat.llm import bpe, queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    prose = lambda n: " ".join(rnd.choice("river stone light house cloud paper green field".split()) + str(rnd.randint(0, 999)) for _ in range(n)) + "."
    data, labels = [], []
    for i in range(120):
        data.append((i, prose(80), 1))
    for i in range(120, 180):
        data.append((i, " ".join(w + "###" for w in prose(80).split()), 0))
    copied = data[3][1]
    data += [(200, copied, 1), (201, copied + " tail", 1), (202, data[4][1] + ' password = "abcdef12345"', 1), (203, None, 0), (204, "short text", 0)]
    for i, _, q in data:
        if i % 2 == 0:
            labels.append((i, q, 0))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t, _ in data], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), data


def test_stages(spark, folder):
    path, data = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.keep_by_rules(spark, docs, path)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= set(range(120)) and not ids & {203, 204}
    good = corpus_pipeline.keep_by_classifier(spark, docs, path)
    ids = {r["doc_id"] for r in good.collect()}
    assert ids >= set(range(120)) and not ids & set(range(120, 180))
    single = corpus_pipeline.keep_one_of_each(spark, docs, path)
    ids = {r["doc_id"] for r in single.collect()}
    assert 3 in ids and not ids & {200, 201} and {203, 204} <= ids
    clean = {r["doc_id"]: r for r in corpus_pipeline.mask_secrets(spark, docs, path).collect()}
    assert len(clean) == len(data) and "abcdef12345" not in clean[202]["text"] and clean[202]["n_chars"] == len(clean[202]["text"])
    assert clean[203]["text"] is None and clean[3]["text"] == data[3][1]


def test_run(spark, folder):
    path, data = folder
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in got}
    assert ids == set(range(120)) | {202} or ids == set(range(120))
    cache = bpe.piece_cache(queries.vocabulary("byte_bpe_50k.json"))
    assert sum(r["length"] for r in got if r["doc_id"] == 7) == len(cache.encode([data[7][1]])[0]) + 1


def test_edges(spark, folder):
    path, data = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0, name
    text = data[5][1]
    odd = spark.createDataFrame([(5, text, "en", "s", 1), (5, text, "en", "s", 1), (5, "zz " + text, "en", "s", 2), (None, text, "en", "s", 3), (None, None, None, None, None), (6, "", "en", "s", 0)], COLUMNS)
    single = corpus_pipeline.keep_one_of_each(spark, odd, path).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in single) == sorted([(5, text), (-1, text), (-1, ""), (6, "")])
    assert corpus_pipeline.keep_by_rules(spark, odd, path).count() == 4
    assert corpus_pipeline.keep_by_classifier(spark, docs.union(odd), path).where("doc_id is null and text is not null").count() == 1
    assert corpus_pipeline.mask_secrets(spark, odd, path).count() == 6
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, odd, path).collect()} == {None, 5, 6}


def test_run_leaves_only_the_last_stage(spark, folder, tmp_path):
    import glob

    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    last = {f.rsplit("/", 2)[0] for f in got.inputFiles()}
    assert len(last) == 1
    kept = glob.glob(last.pop().removeprefix("file://").removeprefix("file:") + "/*")
    assert [k.rsplit("/", 1)[1] for k in kept] == ["4-packing"]
