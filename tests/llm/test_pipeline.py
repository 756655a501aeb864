import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import catalog
from rankloom.llm.toxicity import fit_severity, features

from .test_near_dedup import classes


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_severity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    frames, frame = {}, docs
    for name, step in corpus_pipeline.STAGES:
        frame = step(spark, frame, sf_dir)
        if name != "packing":
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), docs.schema)
        frames[name] = frame

    eta = {i: sum(model.weights.get(f, 0.0) for f in features(t)) for i, t in texts.items()}
    mild = {i for i in texts if 1 / (1 + np.exp(model.thresholds[0] - eta[i])) < 0.5}
    assert {r.doc_id for r in frames["toxicity"].collect()} == mild and len(mild) < len(texts)

    norm = defaultdict(list)
    for i in sorted(mild):
        norm[re.sub(r"[\x20\x09-\x0D]", "", texts[i])].append(i)
    unique = sorted(min(group, key=lambda i: (-len(texts[i]), i)) for group in norm.values())
    assert sorted(r.doc_id for r in frames["exact_dedup"].collect()) == unique

    found = classes([texts[i] for i in unique])
    kept = sorted({unique[c] for c in found.values()})
    assert sorted(r.doc_id for r in frames["near_dedup"].collect()) == kept and len(kept) < len(unique)

    safe = {r.doc_id: r.text for r in frames["pii"].collect()}
    assert sorted(safe) == kept and any(safe[i] != texts[i] for i in kept)
    personal = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}")
    for i in kept:
        before, after = personal.findall(texts[i]), personal.findall(safe[i])
        assert len(before) == len(after) and not set(before) & set(after)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sorted(map(tuple, frames["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in safe.items()}
    assert all(zlib.crc32(np.array(ids[i][s:s + n], "<u4").tobytes()) == crc for i, s, n, crc in pieces)
    assert sum(n for _, _, n, _ in pieces) == sum(map(len, ids.values()))

    ran = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32").collect()))
    cover = defaultdict(int)
    for i, _, n, _ in ran:
        cover[i] += n
    assert cover == {i: len(x) for i, x in ids.items()}


def test_every_operator_is_registered_once():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in catalog.QUERIES if name != "pipeline"]
    assert sorted(numbers) == list(range(1, 14)) and set(catalog.SQL) <= set(catalog.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
