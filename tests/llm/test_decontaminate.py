import random
import re

import pytest
from pyspark.sql import functions as F

from paperlens.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items):
    out = []
    for text in texts:
        words, hit, found, longest = words_of(text), set(), set(), 0
        for name, item in items:
            own = words_of(item)
            length = min(10, len(own))
            for a in range(len(own) - length + 1 if own else 0):
                for p in range(len(words) - length + 1):
                    if words[p:p + length] == own[a:a + length]:
                        hit.update(range(p, p + length))
                        found.add(name)
                        more = length
                        while p + more < len(words) and a + more < len(own) and words[p + more] == own[a + more]:
                            more += 1
                        longest = max(longest, more)
        out.append((len(words), len(hit), sorted(found), longest))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "C9", "d-e", "É"][:rng.randint(2, 5)]
    items = [(str(i), rng.choice([" ", "\n", "-"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 8, 10, 11, 30]))))
             for i in range(rng.randint(0, 6))]
    texts = [" ".join(rng.choice([*vocabulary, "x"]) for _ in range(rng.choice([0, 1, 5, 30, 100])))
             + (" " + rng.choice(items)[1] if items and rng.random() < 0.5 else "") for _ in range(8)]
    return texts, items


@pytest.mark.parametrize("seed", range(60))
def test_shards(seed):
    texts, items = case(seed)
    index = decontaminate.Benchmark(items, 10)
    words = [decontaminate.words_of(t) for t in texts]
    found = decontaminate._matches(index, words)
    assert [(len(w), sum(b - a for a, b in s), i, m) for w, (s, i, m) in zip(words, found, strict=True)] == brute(texts, items)


@pytest.mark.parametrize("block_bytes", [8_000_000, 40])
def test_table(spark, block_bytes):
    texts, items = case(7)
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    rows = [*items, *items[:2], ("n", None), (None, "zz yy")]
    benchmark = spark.createDataFrame(rows, "item_id string, text string")
    found = decontaminate.find_matches(docs, benchmark, block_bytes=block_bytes).withColumn("n_hit", decontaminate.n_hit())
    got = [(r["n_words"], r["n_hit"], r["item_ids"], r["longest_match"]) for r in found.orderBy("doc_id").collect()]
    assert got == brute([*texts, None], items)


def test_edges(spark, edges, none):
    benchmark = spark.createDataFrame([("q", "one two three"), ("q", "one two three")], "item_id string, text string")
    found = decontaminate.find_matches(edges, benchmark)
    assert found.count() == edges.count()
    assert found.where(F.size("item_ids") > 0).count() == 4
    clean = decontaminate.clean_documents(edges, benchmark)
    assert clean.columns == edges.columns and clean.count() == edges.count() - 4
    assert decontaminate.find_matches(none, benchmark).count() == 0
    assert decontaminate.clean_documents(edges, benchmark.limit(0)).count() == edges.count()
