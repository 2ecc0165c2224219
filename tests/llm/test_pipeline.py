import random
import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as cp  # noqa: E402

from quern.llm import decontaminate  # noqa: E402

from . import fixtures as fx  # noqa: E402
from .fixtures import SCHEMA, prose  # noqa: E402
from .test_classifiers import corpus  # noqa: E402


def tables(spark, folder):
    rng = random.Random(6)
    rows, labels = corpus(3, 500)
    passage = prose(rng, 30)
    rows = [(i, t + " " + passage if i % 25 == 3 else t, lang, s, n) for i, t, lang, s, n in rows]
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(1, 60)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "no such item at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, labels, [(1, passage), (2, "no such item at all")]


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels, bench = tables(spark, f"file://{tmp_path}/t")
    sf = f"file://{tmp_path}/t"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    text = {r[0]: r[1] for r in rows}
    good, clean, one, out = kept.values()
    junk = {i for i, q, _ in labels if not q}
    toxic = {i for i, q, t in labels if q and t}
    assert not good.keys() & junk
    assert good.keys() >= {i for i, q, _ in labels if q}
    assert not clean.keys() & toxic
    assert clean.keys() >= {i for i, q, t in labels if q and not t}
    left = [(i, t) for i, t in clean.items()]
    assert one.keys() == {i for i, (_, c) in fx.jaccard(left).items() if i == c}
    dirty = {i for i, f in fx.decontamination(list(one.items()), bench).items() if f[4]}
    assert dirty
    assert {i for i in one if i not in out or out[i] != one[i]} == dirty
    assert not any(f[1] for i, f in fx.decontamination(list(out.items()), bench).items() if i in dirty)
    assert all(t == text[i] for i, t in out.items() if i not in dirty)
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == out.keys()
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert sorted(map(tuple, cp.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_are_named_as_the_operators():
    assert len(cp.STAGES) == 5
    assert cp.ORACLE_SQL is None
    assert decontaminate.is_contaminated(1, 20) and not decontaminate.is_contaminated(1, 21) and not decontaminate.is_contaminated(0, 0)
