"""The pipeline against plain versions of its stages, and the registry without it."""

import hashlib
import pathlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as registry
import corpus_pipeline
from ledgerlens.llm import queries as q
from ledgerlens.session import scratch_dir
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline_against_plain_stages(spark):
    good = {r["doc_id"] for r in q.op2_quality(spark, SF).where("predicted = 1").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    docs = [(r["doc_id"], r["text"], r["source"]) for r in docs if r["doc_id"] in good]
    cleaned = brute.clean_lines(
        [(t, s) for _, t, s in docs], q.SITES_SHARE, q.LEAST_SITES, q.MIN_LINE_CHARS
    )
    texts = {d: t for (d, _, _), t in zip(docs, cleaned)}
    roots = brute.near_prints({d: brute.fingerprint(t) for d, t in texts.items()})
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, t in texts.items():
        words = set((t or "").lower().split())
        likely = [i for i in items if len(words & set(i.lower().split())) > 8]
        if roots[d] == d and not any(brute.contained(t, i) for i in likely):
            ids = library.encode(t, add_special_tokens=False).ids
            digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            want[d] = (len(ids), digest, hashlib.sha256(t.encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    assert len(rows) == len(got)
    assert got == want
    for r in rows:
        text = library.decode(r["ids"], skip_special_tokens=False)
        assert hashlib.sha256(text.encode()).hexdigest() == r["decoded_sha256"]


def test_only_the_result_stays(spark):
    folder = pathlib.Path(scratch_dir(spark))
    before = set(folder.iterdir())
    corpus_pipeline.run(spark, SF)
    made = set(folder.iterdir()) - before
    assert [p.name.rpartition("-")[0] for p in made] == ["BPE-encoding-and-decoding"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()


def test_everything_is_registered():
    names = registry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
