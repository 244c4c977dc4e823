"""The pipeline's stages on the smallest tables and on odd ones, and that registration survives without this subpackage."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hornlake.llm import language_id, pii

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+").findall
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, then what each stage returns."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [x.toPandas().sort_values("doc_id").reset_index(drop=True) for x in out]


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(list(x.columns) == list(stages[0].columns) for x in stages[1:5])
    assert list(stages[5].columns) == ["doc_id", "size", "source_size", "target", "taken", "first_slot", "first_rank", "first_offset"]


def test_language_stage(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classifier = language_id.Classifier(language_id.fit_dictionaries(docs, ~language_id.held_out()))
    kept = {i for i, t in zip(stages[0].doc_id, stages[0].text, strict=True) if classifier.predict(t)[1] >= 0.005}
    assert set(stages[1].doc_id) == kept and len(kept) > 0.95 * len(stages[0])


def test_stages_ask_for_small_batches(spark):
    """Also for frames that are run after the stage has returned; a size that the session has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_contaminated):
        spark.conf.unset(key)
        stage(spark, docs, SF)
        assert spark.conf.get(key) == str(4 << 20)
    spark.conf.set(key, "1000000")
    corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert spark.conf.get(key) == "1000000"
    spark.conf.unset(key)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (2, text + " more"), (2, "quite another text that has words of its own"), (3, None), (None, text), (4, text), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted([(1, text), (2, rows[2][1]), (3, ""), (0, text), (5, "")])


def test_near_duplicate_stage(stages):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = []
    for i, t in zip(stages[1].doc_id, stages[1].text, strict=True):
        w = SPACED(t.translate(lower))
        rows.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in rows:
        for b, y in rows:
            if a < b and x and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert set(stages[2].doc_id) == {i for i, _ in rows if root(i) == i}


def test_decontamination_stage(spark, stages):
    items = [ALNUM(r["text"].lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    clean = set()
    for i, t in zip(stages[2].doc_id, stages[2].text, strict=True):
        w = ALNUM(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            clean.add(i)
    assert set(stages[3].doc_id) == clean and len(clean) < len(stages[2])


def test_personal_data_stage(stages):
    before = dict(zip(stages[3].doc_id, stages[3].text, strict=True))
    assert set(before) == set(stages[4].doc_id)
    changed = 0
    for r in stages[4].itertuples():
        spans = pii.base_spans(before[r.doc_id])
        assert all(before[r.doc_id][a:b] not in r.text for a, b, _ in spans) and r.n_chars == len(r.text)
        if not spans and r.text != before[r.doc_id]:
            changed += 1
        if spans:
            assert "[" + spans[0][2].upper() + "]" in r.text
    assert changed <= 0.02 * len(before)


def test_mixing_stage(stages):
    sizes = {i: len(SPACED(t)) for i, t in zip(stages[4].doc_id, stages[4].text, strict=True)}
    mixed = stages[5]
    assert dict(zip(mixed.doc_id, mixed["size"], strict=True)) == sizes
    assert (mixed.taken <= 3 * mixed["size"]).all()
    source = dict(zip(stages[4].doc_id, stages[4].source, strict=True))
    by = mixed.assign(source=mixed.doc_id.map(source)).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((by.target - by.taken).abs() <= 1).all() and abs(by.target.sum() - mixed["size"].sum()) < 1


def test_odd_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, a further column, and no rows at all."""
    text = "The and of to in that it is was for on with as this be at by from or an " * 4
    rows = [(1, text, "en", "a", 5, "k"), (1, text, "en", "a", 5, "k"), (2, None, None, None, None, None), (None, text + " more of the same words and that", None, None, None, "k"), (3, "", "fr", "b", 0, "k"), (4, "Le la de et que les des une pour dans est qui " * 5, "fr", None, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for table in (docs, docs.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{table.count()}_{name}")
            stage(spark, table, SF).write.parquet(path)
            if k < 4:
                assert spark.read.parquet(path).columns == docs.columns
            stage_rows = spark.read.parquet(path)
            if name == "near_duplicates" and table.count():
                assert stage_rows.filter("doc_id = 1").count() == 1 and stage_rows.filter("doc_id is null").count() == 1


def test_entry_without_the_subpackage(tmp_path):
    for name in ("hornlake", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert 'rule_metrics' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    whole = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and sum(k.startswith('op') for k in q) == 10"
    subprocess.run([sys.executable, "-c", whole], cwd=ROOT, check=True)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id"), language_id.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
