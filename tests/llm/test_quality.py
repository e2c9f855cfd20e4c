import math
from collections import Counter

import numpy as np
import pytest

from paperlens.llm import quality

SPACE = " \t\n\v\f\r"


def words_of(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base(text):
    words = words_of(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated),
            len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_base_measures(documents, texts):
    for r in quality.assess(documents).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) \
            == base(texts[r["doc_id"]])


def test_verdicts_follow_labels(spark):
    folder = "/root/testdata/sf0.01"
    judged = quality.assess(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "base_failed", "kept")
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r["kept"] for r in rows if r["quality"] == 1)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.95 * sum(r["quality"] == 0 for r in rows)


def plain_distance(p, q):
    """Square root of the Jensen-Shannon divergence in bits, term by term."""
    total = 0.0
    for a, b in zip(p, q, strict=True):
        for x in (a, b):
            if x > 0:
                total += x * math.log2(2 * x / (a + b)) / 2
    return math.sqrt(max(0.0, total))


def plain_verdicts(rows):
    """{doc_id: kept} of (doc_id, text, lang) rows of frequent languages, by loops."""
    def classes(text):
        counts = Counter()
        for byte in text.encode():
            c = chr(byte)
            kind = ("foreign" if byte > 127 else "symbol" if c in "#*$%&|<>" else "space" if c in SPACE else "upper" if c.isupper()
                    else "plain" if c.isalnum() else "punctuation" if c in ".,;:!?'\"()-+@/=" else "other")
            counts[kind] += 1
        return tuple(counts[k] for k in quality.CLASSES)

    long = [(i, t, g, classes(t)) for i, t, g in rows if len(words_of(t)) >= 50]
    medians = {}
    for name in {g for *_, g, _ in long}:
        shares = [[n / sum(c) for n in c] for c in {c for *_, g, c in long if g == name}]
        middle = [sorted(column)[math.ceil(len(column) / 2) - 1] for column in zip(*shares)]
        medians[name] = [m / sum(middle) for m in middle]

    def by_class(c):
        return min(plain_distance([n / sum(c) for n in c], m) for m in medians.values()) if sum(c) >= 200 else 0.0

    def lower(text):
        return words_of("".join(c.lower() if c < "\x80" else c for c in text))

    words = {}
    for name in medians:
        counts = Counter(w for _, t, g, c in long if g == name and by_class(c) <= 0.145 for w in lower(t))
        total = sum(counts.values())
        common = sorted(((n / total, w) for w, n in counts.items() if n >= 0.002 * total), key=lambda x: (-x[0], x[1].encode()))
        words[name] = common

    def by_word(text, name):
        own = lower(text)
        groups, counts = len(own) // 50 if len(own) < 300 else None, Counter(own)

        def distance(common):
            mass, seen, wanted, at = sum(s for s, _ in common), {}, {}, 0.0
            for share, word in common:
                g = word if groups is None else min(int(at / mass * groups), groups - 1)
                seen[g], wanted[g], at = seen.get(g, 0) + counts[word] / len(own), wanted.get(g, 0) + share, at + share
            keys = list(wanted)
            return plain_distance([*(seen[k] for k in keys), 1 - sum(seen.values())], [*(wanted[k] for k in keys), 1 - mass])

        limit = 0.24 if len(own) < 300 else 0.35
        return distance(words[name]) <= limit or min(map(distance, words.values())) <= limit

    passed = {i for i, t, g, c in long if not base(t)[-1] and by_class(c) <= 0.145 and by_word(t, g)}
    return {i: i in passed for i, *_ in rows}


def salad(rng, words):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(words))


def test_verdicts_are_those_of_a_plain_version(spark):
    rng = np.random.default_rng(4)
    given = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = given + [(100_000 + n, salad(rng, n), str(rng.choice(["en", "de", "fr", "es"]))) for n in range(50, 420, 5)]
    judged = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    found = {r["doc_id"]: r["kept"] for r in judged}
    assert found == plain_verdicts(rows)
    # Words decide about these alone: their characters are those of a text.
    assert not any(found[100_000 + n] for n in range(60, 420, 5))
    assert all(r["class_distance"] <= quality.CLASS_DISTANCE for r in judged if r["doc_id"] > 100_000)


def test_distance():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.5, 0.5, 0.0]])
    assert quality.js_distance(p, q)[0] == 0
    assert quality.js_distance(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]]))[0] == pytest.approx(1)


def test_references_do_not_depend_on_partitions(documents):
    one, many = quality.references_of(documents.coalesce(1)), quality.references_of(documents.repartition(7))
    assert one.languages == many.languages
    assert np.allclose(one.classes, many.classes)
    assert [w for w, _ in one.words] == [w for w, _ in many.words]
    assert all(np.allclose(a, b) for (_, a), (_, b) in zip(one.words, many.words, strict=True))


def test_edges(edges, none):
    judged = quality.assess(edges)
    assert judged.count() == edges.count()
    assert all(r["base_failed"] and not r["kept"] for r in judged.where("doc_id in (1, 2, 3)").collect())
    assert quality.good_documents(edges).columns == edges.columns
    assert quality.assess(none).count() == 0 and quality.good_documents(none).count() == 0


def test_clean_documents_of_rare_languages_stay(spark):
    """24 documents in a language of its own script and 5 in another, in a table of 30,000 and more."""
    rng = np.random.default_rng(1)

    def text(letters, words):
        kinds = ["".join(rng.choice(list(letters), 5)) for _ in range(60)]
        return lambda more=0: " ".join(rng.choice(kinds, words + more))

    latin, thai, greek = text("abcdefghijkl", 55), text("กขคงจฉชซ", 400), text("αβγδεζηθ", 400)
    # References are medians of different counts of character classes.
    rows = [(i, latin(i % 40) + " " + "A" * (i // 40 % 30) + "." * (i // 1_200), "en") for i in range(30_000)]
    rows += [(100_000 + i, thai(i), "th") for i in range(24)] + [(200_000 + i, greek(i), "el") for i in range(5)]
    junk = text("#*$%|<>&", 400)()
    rows += [(300_000, junk, "th"), (300_001, junk, "en"), (300_002, junk, "el")]
    judged = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 100000").collect()
    assert all(r["kept"] for r in judged if r["doc_id"] < 300_000 and not r["base_failed"])
    assert sum(not r["base_failed"] for r in judged if r["doc_id"] < 300_000) == 29
    assert not any(r["kept"] for r in judged if r["doc_id"] >= 300_000)
