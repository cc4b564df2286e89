"""The pipeline's stages one by one, each on its own input and against plain Python, and whole runs."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_plain import SPACED, plain_components, plain_hits, plain_targets
from treeline.llm import decontaminate, langid


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, at = spark.read.parquet(f"{sf}/documents.parquet"), tmp_path_factory.mktemp("stages")
    found = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, found[-1], sf).write.parquet(str(at / name))
        found.append(spark.read.parquet(str(at / name)))
    return found


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_columns_and_clean_documents(stages):
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert after.columns == before.columns
    assert stages[1].count() >= 0.99 * stages[0].count()


def test_language_stage_is_the_model_row_by_row(stages):
    model = langid.train(stages[0])
    want = {d["doc_id"] for d in rows(stages[0]) if (p := model.predict(d["text"]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert {d["doc_id"] for d in rows(stages[1])} == want


def test_one_document_of_each_group_stays(stages):
    groups = plain_components([(d["doc_id"], d["text"]) for d in rows(stages[1])])
    assert {d["doc_id"] for d in rows(stages[2])} == {root for _, root in groups.values()}
    assert stages[2].count() < stages[1].count()


def test_leaks_are_cut(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/benchmark.parquet"))]
    after = {d["doc_id"]: d["text"] for d in rows(stages[3])}
    found = 0
    for d in rows(stages[2]):
        n, hit, _ = plain_hits(d["text"], items)
        found += bool(hit)
        if len(hit) > 0.5 * max(1, n):
            assert d["doc_id"] not in after
        elif not hit:
            assert after[d["doc_id"]] == d["text"]
        else:
            words = decontaminate.words_of(d["text"])
            assert decontaminate.words_of(after[d["doc_id"]]) == [w for i, w in enumerate(words) if i not in hit]
    assert found


def test_mix_meets_its_targets(stages):
    before, after = {d["doc_id"]: d for d in rows(stages[3])}, collections.Counter(d["doc_id"] for d in rows(stages[4]))
    size = {k: len(SPACED.findall(d["text"] or "")) for k, d in before.items()}
    sizes, taken = collections.Counter(), collections.Counter()
    for k, d in before.items():
        sizes[d["source"]] += size[k]
        taken[d["source"]] += size[k] * after[k]
    wanted = plain_targets(sizes)
    longest = max(size.values())
    assert set(after) <= set(before) and max(after.values()) <= 3
    assert all(wanted[s] - longest <= taken[s] <= wanted[s] + 1 for s in sizes)


def test_output_holds_the_mix(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(stages[5]))
    want = []
    for d in rows(stages[4]):
        ids = np.array([*library.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((d["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((a, c, d) for a, _, c, d in got) == sorted(want)
    starts, at = [], 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        starts.append(start == at)
        at += n
    assert all(starts) and [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(r[0] for r in got)


def test_whole_runs_take_odd_tables(spark, sf, tmp_path):
    """Nulls in any column, repeated ids, rows that are there twice, more columns than expected; and nothing at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "The text of one that is there twice and more, said once again.", None, None, None), (1, "The text of one that is there twice and more, said once again.", None, None, None), (2, "12 345", "en", "s", 6)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"row": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5)})
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, table in (("odd", more), ("empty", more.limit(0))):
        at = str(tmp_path / name)
        table.write.parquet(f"{at}/documents.parquet")
        (bench if name == "odd" else bench.limit(0)).write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at)
        assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (got.count() > 0) == (name == "odd")
