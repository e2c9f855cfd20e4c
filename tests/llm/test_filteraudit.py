import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlens.llm import filteraudit


def brute(docs, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    smallest = {}
    for i, text, _ in docs:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    judged = []
    for i, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": re.search(r"[#$%&*|]", text) is not None,
            "E": i is not None and i > smallest[text],
        }
        judged.append((part or "", {f for f, failed in fails.items() if failed}, i in good, i in toxic))
    found = []
    for part in {p for p, *_ in judged}:
        rows = [r[1:] for r in judged if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[f] += len(gone)
                lines.append((f, "".join(order), step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                              sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
        found += [(part, *line[1:], shapley[line[0]]) for line in lines]
    return sorted(found)


def plain(df):
    assert df.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                          "toxic_lost", "shapley"]
    return sorted(map(tuple, df.collect()))


def check(docs, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    flags = [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()]
    found = plain(filteraudit.audit(docs, labels))
    assert found == brute(rows, flags)
    return found


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    found = check(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert len(found) == 600 * 4 and all(any(row[at] for row in found) for at in range(3, 10))


def test_edges(spark, edges, none):
    labels = spark.createDataFrame(
        [(5, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, None), (7, 1, None)], "doc_id long, quality int, toxic int")
    check(edges.repartition(3), labels.withColumn("_key", F.lit("x")))
    check(edges, labels.limit(0))
    assert filteraudit.audit(none, labels).count() == 0


def test_one_text_and_one_key_for_all(spark):
    docs = spark.range(3_000).select(
        F.when(F.col("id") % 2 == 0, F.col("id")).when(F.col("id") % 3 == 0, 7).alias("doc_id"),
        F.lit("same # text").alias("text"), F.when(F.col("id") % 5 > 0, F.lit("en")).alias("lang"))
    labels = docs.where("doc_id is not null").distinct().select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    check(docs.repartition(4), labels)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 100, 1_000])
def test_carry_save_counts(n):
    rng = np.random.default_rng(n)
    words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    copies = rng.integers(0, 1 << 40, n) if n % 2 else np.ones(n, dtype=np.int64)
    bits = (words[:, None].astype(np.int64) >> np.arange(32)) & 1
    assert (filteraudit.subset_counts(words, copies) == (bits * copies[:, None]).sum(axis=0)).all()


def test_words_of_masks():
    for failed in range(32):
        for subset in range(32):
            assert bool(int(filteraudit.SURVIVES[failed]) >> subset & 1) == (failed & subset == 0)
