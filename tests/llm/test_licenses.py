import re

from pyspark.sql import functions as F

from paperlens.llm import licenses


def shingles(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    if len(words) < 5:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)]


def brute(text, templates=licenses.TEMPLATES):
    """Templates whose shingles a window of the text contains to 80 %."""
    own, found = shingles(text), set()
    for name, wording in templates:
        wanted = list(dict.fromkeys(shingles(wording)))
        for start in range(0, len(own), len(wanted)):
            window = own[start:start + licenses.SPAN * len(wanted)]
            if len(set(window) & set(wanted)) >= 0.8 * len(wanted):
                places = [start + i for i, s in enumerate(window) if s in set(wanted)]
                found.add((name, places[0], places[-1] + 5))
    return sorted(a for a in found if not any(
        b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b != a for b in found))


def spans(row):
    return [(m["license"], m["start"], m["end"]) for m in row["licenses"]]


def test_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    found = {r["doc_id"]: spans(r) for r in licenses.scan(documents).collect()}
    assert found == {i: brute(t) for i, t in texts.items()}
    assert sum(map(bool, found.values())) > 10


def test_long_templates_and_changed_words(spark):
    wording = dict(reversed(licenses.TEMPLATES))["MIT"]
    longest = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len)
    words = longest.split()
    changed = " ".join([*words[:20], "altered", *words[21:]])
    broken = " ".join(w if i % 6 else "x" for i, w in enumerate(words))
    docs = spark.createDataFrame(
        [(1, "intro " * 33 + longest + " outro" * 50), (2, "a b c " * 70 + changed), (3, broken), (4, wording)], "id int, text string")
    found = {r["id"]: [m["license"] for m in r["licenses"]] for r in licenses.scan(docs).collect()}
    assert found == {1: ["MIT"], 2: ["MIT"], 3: [], 4: ["MIT"]}


def test_copies_with_words_put_in_are_found_wherever_they_stand(spark):
    """Against all positions: every text that holds 80 % of a template within three of its lengths."""
    wording = max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len).split()
    length = len(set(shingles(" ".join(wording))))
    rows = []
    for gap in (0, 10, 34, 51, 86, 150, 2 * length - 20):
        for place in range(16):
            at = place * 23 + 5
            cut = len(wording) // 2 if place % 2 else len(wording) // 5
            words = [f"a{i}" for i in range(at)] + wording[:cut] + [f"b{i}" for i in range(gap)] + wording[cut:]
            rows.append((len(rows), " ".join(words + [f"c{i}" for i in range(300 - at)])))
    for n, text in rows:
        own, wanted = shingles(text), set(shingles(" ".join(wording)))
        near = max(len(set(own[s:s + 3 * length]) & wanted) for s in range(len(own)))
        assert near >= 0.8 * len(wanted)
    found = {r["id"]: [m["license"] for m in r["licenses"]] for r in licenses.scan(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert all("MIT" in names for names in found.values()) and len(found) == 7 * 16


def test_plan_has_no_python(documents, plan):
    assert "Python" not in plan(licenses.scan(documents)) and "Arrow" not in plan(licenses.scan(documents))


def test_edges(edges, none):
    found = licenses.scan(edges)
    assert found.count() == edges.count() and "text" not in found.columns
    assert [r["doc_id"] for r in found.where(F.size("licenses") > 0).collect()] == [9]
    assert licenses.scan(none).count() == 0
    assert licenses.scan(edges, templates=()).where(F.size("licenses") > 0).count() == 0
