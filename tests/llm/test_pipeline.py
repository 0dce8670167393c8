import hashlib

import corpus_pipeline
import pyarrow as pa
from docs import EXTRA
from pyspark.sql import functions as F
from test_simhash import similar_groups

from saldospark.llm import bpe, decontaminate, langid, queries, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_chain(spark, sf_dir):
    """Each stage is held against a plain version of its decision on the rows that it gets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.columns == COLUMNS
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    index = decontaminate.build([(r["item_id"], r["text"]) for r in bench])
    words = secrets.word_finder(secrets.word_ranks(open(queries.VOCABULARY, "rb").read()))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir).persist()
        kept[name] = after = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == COLUMNS
        ids = [r["doc_id"] for r in after]
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.97 * len(before)
        if name == "near_dedup":
            before = sorted(before, key=lambda r: r["doc_id"])
            assert sorted(ids) == sorted({before[g]["doc_id"] for g in similar_groups([r["text"] for r in before])})
        if name == "decontamination":
            assert sorted(ids) == sorted(r["doc_id"] for r in before if not decontaminate.matches(index, [r["text"]]))
        if name == "secret_scan":
            assert len(after) == len(before)
            for a, b in zip(sorted(before), sorted(after)):
                base = secrets.base_spans(a["text"])
                assert b["text"] == secrets.redact(a["text"], [*base, *secrets.guessed_spans(a["text"], base, words)]) and b["n_chars"] == len(b["text"])
        if name == "byte_bpe":
            texts = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"]: r["decoded_sha256"] for r in after} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_run_and_odd_tables(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the river", "en", "s", 9), (3, "the river " * 20, "en", "s", 200), (3, "the river " * 20, "en", "s", 200), (4, "le fleuve " * 20, "fr", "s", 200)]
    for rows in (odd, []):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        assert {r["doc_id"] for r in got} <= {3, 4, None} and len(got) == len({r["doc_id"] for r in got})
    assert EXTRA and len(corpus_pipeline.STAGES) == 5 and langid.UNDETERMINED == "und" and bpe.MAX_CACHE > 0


def test_stages_send_text_in_small_batches(spark, sf_dir):
    """A task's whole text (here 20 MB) must not stand in one Arrow batch; the setting ends with the pipeline."""
    before = spark.conf.get(corpus_pipeline.BATCH[0])
    docs = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    def largest(spark, docs, sf_dir):
        return docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes"))

    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
    try:
        assert corpus_pipeline.small_batches(largest)(spark, docs, sf_dir).first()[0] < 4 << 20
    finally:
        spark.conf.set(corpus_pipeline.BATCH[0], before)
    corpus_pipeline.run(spark, sf_dir)
    assert spark.conf.get(corpus_pipeline.BATCH[0]) == before
