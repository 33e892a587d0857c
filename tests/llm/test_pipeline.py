"""The pipeline's stages on the smallest documents, each against a brute-force version of what it decides."""

import collections
import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import models  # noqa: E402

from ridgeway.llm import mixing, queries  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def test_stages(spark, tmp_path):
    """Every stage against the plain model of its decisions, on what the stage before it kept."""
    docs, kept = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, DATA)
        if name != "sentencepiece":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        kept[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
    assert list(kept) == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "sentencepiece"]
    whole = texts(docs)
    good = {i: t for i, t in whole.items() if models.passes_rules(t)}
    assert texts(kept["quality_rules"]) == good
    lines = models.without_shared_lines(good)
    assert texts(kept["line_dedup"]) == lines
    root = models.groups(lines, 5)
    alone = {i: t for i, t in lines.items() if root[i] == i}
    assert texts(kept["near_duplicates"]) == alone
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = kept["near_duplicates"].select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), (-F.log(u) / mixing.quality(F.col("text"))).alias("key")).collect()
    assert all(r["size"] == len(models.WORD.findall(alone[r["doc_id"]])) for r in keyed)
    targets = {r["source"]: r["target"] for r in mixing.mix(kept["near_duplicates"]).select("source", "target").distinct().collect()}
    repeats = models.mix_repeats([tuple(r) for r in keyed], targets)
    assert collections.Counter(r["doc_id"] for r in kept["mix_sources"].collect()) == +collections.Counter(repeats)
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    hexa = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids := lib.encode(t)), hexa(",".join(map(str, ids))), hexa(lib.decode(ids))) for i, t in alone.items() if repeats[i]}
    got = [tuple(r) for r in kept["sentencepiece"].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted((i, *want[i]) for i, n in repeats.items() for _ in range(n))
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, kept["sentencepiece"].collect()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rows = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).values.tolist()))
    assert rows(queries.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(queries.oracle_sql()[name]).df())
