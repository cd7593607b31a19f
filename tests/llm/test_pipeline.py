import os
import subprocess
import sys

import corpus_pipeline as p
from pyspark.sql import functions as F
from tables import EDGES, rows
from test_decontaminate import fewest
from test_jaccard import reach

from slabworks.llm import common, decontaminate, piece_codec
from slabworks.llm.language_id import has_letter

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(docs, items):
    """Ids that every stage leaves, each by its plainest form."""
    left = [(i, t) for i, t in docs if t and has_letter(t)]
    yield {i for i, _ in left}
    first = {}
    for i, t in sorted(left):
        first.setdefault(_squeezed(t), (i, t))
    left = sorted(first.values())
    yield {i for i, _ in left}
    root = reach(left)  # five words, similarity of 0.8 or more
    left = [(i, t) for i, t in left if root[i] == i]
    yield {i for i, _ in left}
    texts = [(i, t, decontaminate.normalise(t.encode())) for i, t in left]
    left = [(i, t) for i, t, n in texts if not any((x in n) or (len(n) < 4000 and fewest(x, n) <= decontaminate.budget(len(x))) for x in items)]
    yield {i for i, _ in left}


def _squeezed(t):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_stages_against_brute_force(spark):
    items = [decontaminate.normalise(t.encode()) for _, t in rows("benchmark", "item_id, text", SF)]
    want = list(brute(rows(sf=SF), items))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    for (_, stage), ids in zip(p.STAGES[:4], want):
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS and sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == sorted(ids)
    out = p.run(spark, SF)
    codec, texts = piece_codec.PieceCodec(piece_codec.default_model()), dict(rows(sf=SF))
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(found) == want[3]
    for i, r in found.items():
        assert r["decoded"] == texts[i] and r["n_tokens"] == len(r["ids"]) == len(codec.encode(texts[i])) // 4


def test_edges_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in EDGES], "doc_id long, text string, lang string, source string, n_chars long")
    empty = f"{tmp_path}/empty"
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert p.run(spark, empty).count() == 0
    docs = df
    for n, (_, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, empty)
        assert docs.columns == COLUMNS if n < 4 else True
    assert docs.count() == 5


def test_a_run_leaves_its_result_alone(spark, monkeypatch, tmp_path):
    """Tables that stages wrote on the way are deleted when the next stage has been written."""
    monkeypatch.setattr(common, "shared_root", lambda spark: f"file://{tmp_path}")
    assert p.run(spark, SF).count() > 0
    assert [x.rpartition("-")[0] for x in os.listdir(tmp_path)] == ["slabworks-stage-sentencepiece"]


def test_language_stage_decides_by_its_model(spark):
    """A text with letters goes where the model finds it far from every language; without a model it stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    far = spark.createDataFrame([(10**9, "Это тест для определения языка, который должен быть отклонён. " * 3)], "doc_id long, text string")
    docs = docs.unionByName(far, allowMissingColumns=True)
    assert p.identify_language(spark, docs, SF).where("doc_id = 1000000000").count() == 0
    assert p.identify_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).where("doc_id = 1000000000").count() == 1


def test_the_rest_works_without_this_subpackage():
    code = "import sys; sys.modules['slabworks.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=p.__file__.rpartition("/")[0])
