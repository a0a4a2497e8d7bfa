"""The pipeline against what its stages do one by one in plain Python."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(1)
    prose = [" ".join(f"w{rng.randrange(3000)}" for _ in range(120)) for _ in range(30)]
    near = [" ".join(["new", *t.split()[1:]]) for t in prose[:5]]
    texts = [*prose, *prose[:5], *near, "too short", "same words again " * 40, prose[6][:300] + " password=abcdefgh123 " + prose[7][:400]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {i: t for i, t in enumerate(texts) if i < 30}
    want[len(texts) - 1] = texts[-1].replace("password=abcdefgh123", "[SECRET]")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"] for r in got} == set(want)
    for r in got:
        ids = [*own.encode_ordinary(want[r["doc_id"]]), 0]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b " * 40, None, None, 160), (None, None, None, None, None)], schema)
    docs.filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.filter("false")):
            assert stage(spark, df, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
            stage(spark, df, str(tmp_path)).collect()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
