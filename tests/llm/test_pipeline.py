"""Each stage of the pipeline against a plain version on its own input."""

import re

import duckdb
import numpy as np

import corpus_pipeline
from vetloom.llm import langid, oracles, quality
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_wide

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").union(spark.createDataFrame([(10_000, None, "en", "s", None), (10_001, "12 !!", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, small_dir)
        rows = out.collect()
        if name == "language ID":
            model = langid.fit(docs.filter(langid.fold(docs["doc_id"]) != 2), "text", "lang")
            for r in before:
                x = np.log1p(langid.counts(np_array([r.text]))[0]) * model.idf
                cosines = model.centroids @ (x / max(1e-12, np.linalg.norm(x)))
                stays = any(c.isalpha() for c in r.text or "") and cosines.max() >= model.limits[np.argmax(cosines)]
                assert stays == (r.doc_id in {k.doc_id for k in rows})
        if name == "quality classifier":
            model = quality.fit(docs, labels, quality.graded(labels))
            for r in before:
                _, place, value = quality.features(np_array([r.text]))
                s = float((model.weights[place] * value).sum())
                assert (1 / (1 + np.exp(model.thresholds[-1] - s)) >= quality.KEEP) == (r.doc_id in {k.doc_id for k in rows})
        if name == "SimHash near-dedup":
            label = slow_wide([r.text for r in before])
            wanted = {min(r.doc_id for r, x in zip(before, label, strict=True) if x == one) for one in set(label.tolist())}
            kept = {r.doc_id for r in rows}
            assert wanted <= kept and len(kept - wanted) <= 2  # a pair at the edge of the budget may be missed
        if name == "substring dedup":
            db = duckdb.connect()
            db.register("documents", docs.toPandas())
            want = {w[0]: w for w in db.execute(oracles.OP1.replace("sha256(coalesce(kept.t, ''))", "coalesce(kept.t, '')")).fetchall()}
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in rows} == set(want)
            for r in rows:  # a text without removed words stays as it is; else its words are those that the twin keeps
                assert r.text == texts[r.doc_id] if want[r.doc_id][2] == 0 else re.findall(r"[^\x20\x09-\x0D]+", r.text) == want[r.doc_id][3].split(" ")
                assert r.n_chars == len(r.text)
        if name == "best-fit packing":
            check([tuple(r) for r in before], rows, 2048)
        else:
            assert out.columns == COLUMNS and 0 < len(rows) <= len(before)
        docs = out


def np_array(texts):
    import pyarrow as pa

    return pa.array(texts, pa.string())


def test_run(spark, small_dir):
    assert corpus_pipeline.run(spark, small_dir).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark, small_dir, tmp_path):
    spark.read.parquet(f"{small_dir}/documents.parquet").filter("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
