import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from paperlens.llm import decontaminate, neardup, quality, secrets
from tests.llm.test_neardup import brute_classes

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_what_a_plain_version_keeps(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in documents.collect()}
    references = quality.references_of(documents)
    kept = {}
    for i, r in rows.items():
        data = r["text"].encode()
        words = data.split()
        if len(words) < 50 or 100 * quality.repeated_words(words) > 50 * len(words):
            continue
        if references.class_distance(quality.class_counts(data)) > quality.CLASS_DISTANCE:
            continue
        if references.word_distance(data.lower().split(), r["lang"]) <= quality.WORD_DISTANCE:
            kept[i] = r["text"]
    weights = neardup.weights_of(spark.createDataFrame(list(kept.items()), "doc_id long, text string"), "text")
    classes = brute_classes(list(kept), list(kept.values()), weights)
    kept = {i: kept[i] for i in set(classes.values())}
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        own = decontaminate.words_of(r["text"])
        windows |= {tuple(own[i:i + 10]) for i in range(max(1, len(own) - 9)) if own}
    lengths = {len(w) for w in windows}

    def dirty(text):
        own = decontaminate.words_of(text)
        return any(tuple(own[i:i + n]) in windows for n in lengths for i in range(len(own) - n + 1))

    kept = {i: t for i, t in kept.items() if not dirty(t)}
    wanted = {}
    for i, text in kept.items():
        for start, _, end in reversed(secrets.spans_of(text)):
            text = text[:start] + "\0" * (end - start) + text[end:]
        wanted[i] = re.sub("\0+", "[secret]", text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: np.frombuffer(r["token_ids"], "<u4").tolist() for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert found == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in wanted.items()}
    assert 0 < len(found) < len(rows)


def test_stages_take_edge_rows(spark, edges):
    docs = edges
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert stage(spark, edges, FOLDER).count() <= edges.count()
        assert stage(spark, edges.limit(0), FOLDER).count() == 0
        docs = out
