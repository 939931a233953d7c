"""The corpus pipeline on a small corpus: each stage's decisions on its own input."""

import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from callgrove.llm import bpe
from callgrove.llm.common import written
from tests.llm import brute
from tests.llm.data import table


def test_stages(spark, tmp_path):
    r = random.Random(8)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(3, 8))) for _ in range(500)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    docs = {k: " ".join(prose(60)) for k in range(300)}
    toxic = set(range(0, 300, 6))
    for k in toxic:
        docs[k] += " zqurva zqurvos zqurv"
    item = " ".join(prose(30))
    docs |= {400: docs[1], 401: docs[1] + " more", 402: " ".join(prose(20)) + " " + item, 403: " ".join(prose(60)) + " password=abcdef12345", 404: None, 405: ""}
    sf = tmp_path.as_uri()
    table(spark, docs).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = left
        left = written(stage(spark, before, sf), name)
        seen[name] = left
        if name != "byte_bpe":
            assert left.columns == before.columns
    ids = {n: {x.doc_id for x in df.select("doc_id").collect()} for n, df in seen.items()}
    assert ids["toxicity"] == set(docs) - toxic
    assert ids["simhash_near_dedup"] == ids["toxicity"] - {400, 401, 405}
    clean = {x[0] for x in brute.contamination([(k, docs[k]) for k in ids["simhash_near_dedup"]], [(1, item)]) if not x[-1]}
    assert ids["benchmark_decontamination"] == clean and 402 not in clean
    assert ids["secret_scans"] == clean and ids["byte_bpe"] == clean
    assert "password" not in seen["secret_scans"].where("doc_id = 403").first().text
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = {x.doc_id: x.text for x in seen["secret_scans"].collect()}
    for x in seen["byte_bpe"].collect():
        want = library.encode_ordinary(texts[x.doc_id] or "")
        assert np.frombuffer(x.ids, "<u4").tolist() == want and x.n_tokens == len(want)
    assert corpus_pipeline.run(spark, sf).count() == len(clean)
