import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperlens.llm import secrets

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


PIECES = ["token", "TOKEN", "passwd", "password", "api_key", "apiKey", "secret", "=", ":", " ", '"', "'", "abcdef0123", "ABC",
          "AKIA", "AKIAAKIA", "Z9Z9Z9", "é", "ſecret", "toKen", "deadbeef" * 3, "a", "f0", "İ", "\n", "----", "ghp_"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert [s for s in secrets.spans_of(text) if s[1] < 3] == brute(text)


def test_checksums():
    body = "aB3" * 10
    good = body + secrets.checksum(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert secrets.spans_of(f"x ghp_{good} npm_{good} ghp_{bad} npm_{good}Z") == [(2, 3, 42), (43, 4, 83)]


def test_documents(documents, texts):
    for r in secrets.find_secrets(documents.select("doc_id", "text")).collect():
        assert [(s["start"], secrets.KINDS.index(s["kind"]), s["end"]) for s in r["secrets"]] == secrets.spans_of(texts[r["doc_id"]])


def test_edges(edges, none):
    found = secrets.find_secrets(edges)
    assert found.count() == edges.count()
    assert {r["doc_id"] for r in found.where(F.size("secrets") > 0).collect()} == {7, 8}
    assert secrets.find_secrets(none).count() == 0
    masked = secrets.redacted(edges)
    assert masked.columns == edges.columns
    rows = {r["doc_id"]: r["text"] for r in masked.where("doc_id is not null").collect()}
    assert rows[1] is None and rows[4] == "One two three"
    assert rows[7].endswith("w4999 [secret] [secret]") or rows[7].count("[secret]") == 2
