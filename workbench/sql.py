"""SQL twins of the registered queries, over the same tables. Parts are shared as common table expressions."""

from __future__ import annotations

from paperlens.functions.text import NUMERIC_MASKS, SENTENCE_END, TOKEN

D, W = 64, 100
AREAS = "('A1', 'de')"
JOURNALS = "('src1', 'src6', 'src11')"

_YEAR = "CAST(2015 + (doc_id // 20) % 5 AS INTEGER)"
_MONTH = "CAST(1 + doc_id % 12 AS INTEGER)"
# Fixed value: the form of a sort date.
_DATE_PATTERN = "^201[5-9](0[1-9]|1[012])(0[1-9]|[12][0-9]|3[01])$"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _masked(column: str) -> str:
    for pattern, tag in NUMERIC_MASKS:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(tag)}, 'g')"
    return column


def _sentences(column: str) -> str:
    return rf"string_split(regexp_replace({column}, {_quoted(SENTENCE_END)}, '\1' || chr(10), 'g'), chr(10))"


def _tokenized(source: str, id: str, column: str) -> str:
    """(id, sentence, pos, term)."""
    return (
        f"SELECT id, sentence, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM ("
        f"SELECT id, sentence, regexp_extract_all(body, {_quoted(TOKEN)}) AS terms FROM ("
        f"SELECT {id} AS id, unnest(range(len({_sentences(column)}))) AS sentence, "
        f"unnest({_sentences(column)}) AS body FROM {source}))"
    )


def r6(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS {name}"


def _areas(column: str, name: str = "subjareas") -> str:
    return f"array_to_string(list_sort({column}), ',') AS {name}"


def _mean_vectors(source: str, keys: str, width: int) -> str:
    """(keys, embedding) from (keys, embedding)."""
    return (
        f"SELECT {keys}, list(m ORDER BY pos) AS embedding FROM ("
        f"SELECT {keys}, pos, avg(x) AS m FROM ("
        f"SELECT {keys}, unnest(range({width})) AS pos, unnest(embedding) AS x FROM {source}) "
        f"GROUP BY {keys}, pos) GROUP BY {keys}"
    )


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _idf(docs: str, tokens: str) -> str:
    return (
        f"SELECT term AS token, ln((SELECT count(DISTINCT id) FROM {docs}) / count(DISTINCT id)) AS weight "
        f"FROM {tokens} GROUP BY term"
    )


def _tfidf(tokens: str, idf: str, unknown: str) -> str:
    return (
        f"SELECT c.id, c.term, c.n / t.total * coalesce(w.weight, {unknown}) AS weight "
        f"FROM (SELECT id, term, CAST(count(*) AS DOUBLE) AS n FROM {tokens} GROUP BY id, term) c "
        f"JOIN (SELECT id, count(*) AS total FROM {tokens} GROUP BY id) t ON c.id = t.id "
        f"LEFT JOIN {idf} w ON c.term = w.token"
    )


def _embedded(bow: str) -> str:
    """(id, embedding) as weighted mean of word vectors."""
    return (
        f"SELECT id, list(s / n ORDER BY pos) AS embedding FROM ("
        f"SELECT id, pos, sum(x * weight) AS s, sum(weight) AS n FROM ("
        f"SELECT b.id, b.weight, unnest(range({W})) AS pos, unnest(v.embedding) AS x "
        f"FROM {bow} b JOIN word_vectors v ON b.term = v.word) GROUP BY id, pos) WHERE n <> 0 GROUP BY id"
    )


def _long(source: str, keys: str, width: int) -> str:
    return (
        f"SELECT {keys}, CAST(pos AS INTEGER) AS pos, {r6('x', 'value')} FROM (SELECT {keys}, unnest(range({width})) AS pos, "
        f"unnest(embedding) AS x FROM {source})"
    )


_MAX_IDF = "(SELECT greatest(coalesce(max(weight), 0), 0) FROM {})"

# Parts in order of dependence: name -> (body, names it uses).
_PARTS: dict[str, tuple[str, str]] = {
    "papers": (
        "SELECT CAST(doc_id AS VARCHAR) AS eid, source AS issn, string_split(text, chr(10))[1] AS title, "
        "text AS abstr, [lang, 'A' || (doc_id % 5)] AS subjareas, 'Journal ' || source AS sourcetitle, "
        f"{_YEAR} AS year, {_MONTH} AS month FROM documents", ""),
    "raw": (
        "SELECT CAST(doc_id AS VARCHAR) AS eid, source AS issn, lang, doc_id, "
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE string_split(text, chr(10))[1] END AS title, text AS abstr, "
        f"CASE WHEN doc_id % 13 = 0 THEN '2015-01-01' ELSE {_YEAR} || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') || '15' END "
        "AS datesort, [lang, 'A' || (doc_id % 5)] AS subjareas FROM documents", ""),
    "raw_authors": (
        "SELECT doc_id, eid, issn, title, datesort, subjareas, 'a' || (doc_id % 37) AS auid, "
        "'S' || (doc_id % 37 % 7) AS surname, 'N' || (doc_id % 5) AS indexed_name FROM raw UNION ALL "
        "SELECT doc_id, eid, issn, title, datesort, subjareas, 'b' || (doc_id * 7 % 41), "
        "'S' || (doc_id * 7 % 41 % 7), 'N' || (doc_id % 5) FROM raw", "raw"),
    "dated_authors": (
        f"SELECT eid, issn, year, month, 'a' || (CAST(eid AS BIGINT) % 37) AS auid FROM papers UNION ALL "
        f"SELECT eid, issn, year, month, 'b' || (CAST(eid AS BIGINT) * 7 % 41) FROM papers", "papers"),
    "areas": ("SELECT eid, issn, unnest(subjareas) AS area FROM papers", "papers"),
    "journal_areas": ("SELECT issn, list_sort(list(DISTINCT area)) AS areas FROM areas GROUP BY issn", "areas"),
    "submissions": (
        "SELECT CAST(item_id AS VARCHAR) AS query_id, text, 'src' || (item_id % 20) AS target_issn, "
        "CAST(2018 + item_id % 2 AS INTEGER) AS year FROM benchmark", ""),
    "abstract_tokens": (_tokenized("papers", "eid", "abstr"), "papers"),
    "title_tokens": (_tokenized("papers", "eid", "title"), "papers"),
    "all_tokens": (
        "SELECT id, term FROM abstract_tokens UNION ALL SELECT id, term FROM title_tokens",
        "abstract_tokens title_tokens"),
    "submission_tokens": (_tokenized("submissions", "query_id", "text"), "submissions"),
    "idf": (_idf("all_tokens", "all_tokens"), "all_tokens"),
    "bow": (_tfidf("abstract_tokens", "idf", _MAX_IDF.format("idf")), "abstract_tokens idf"),
    "submission_bow": (_tfidf("submission_tokens", "idf", "0"), "submission_tokens idf"),
    "word_vectors": (
        "SELECT term AS word, list_transform(range(100), lambda i: CAST((length(term) * (i + 1) + ascii(term) * (i % 7) "
        "+ ascii(reverse(term)) * (i % 3)) % 17 AS DOUBLE)) AS embedding "
        f"FROM (SELECT DISTINCT unnest(regexp_extract_all(text, {_quoted(TOKEN)})) AS term FROM documents) "
        "WHERE length(term) > 1", ""),
    "text_vectors": (_embedded("bow"), "bow word_vectors"),
    "submission_vectors": (_embedded("submission_bow"), "submission_bow word_vectors"),
    "vectors": ("SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings", ""),
    "paper_vectors": (
        "SELECT v.id, v.embedding, p.issn, p.year, p.subjareas FROM vectors v JOIN papers p ON v.id = p.eid",
        "vectors papers"),
    "text_paper_vectors": (
        "SELECT v.id, v.embedding, p.issn, p.year, p.subjareas FROM text_vectors v JOIN papers p ON v.id = p.eid",
        "text_vectors papers"),
    "centroids": (_mean_vectors("paper_vectors", "issn", D), "paper_vectors"),
    "year_centroids": (_mean_vectors("paper_vectors", "issn, year", D), "paper_vectors"),
    "text_year_centroids": (_mean_vectors("text_paper_vectors", "issn, year", W), "text_paper_vectors"),
    "journal_distances": (
        f"SELECT c.issn AS query_id, v.id, {_d2('c.embedding', 'v.embedding')} AS d2 FROM centroids c, vectors v",
        "centroids vectors"),
    "area_papers": (f"SELECT DISTINCT eid, issn FROM areas WHERE area IN {AREAS}", "areas"),
    "journal_index": (
        "SELECT issn, CAST(row_number() OVER (ORDER BY n DESC, issn) - 1 AS INTEGER) AS index FROM "
        "(SELECT issn, count(*) AS n FROM area_papers GROUP BY issn)", "area_papers"),
    "area_index": (
        "SELECT area, CAST(row_number() OVER (ORDER BY area) - 1 AS INTEGER) AS areaIndex FROM "
        "(SELECT DISTINCT area FROM areas)", "areas"),
    "snapshots": (
        "SELECT CAST(c_custkey AS VARCHAR) AS auid, CAST(floor(c_acctbal / 100) AS BIGINT) AS hindex, 0 AS src FROM customer "
        "UNION ALL SELECT CAST(o_custkey AS VARCHAR), count(*), 1 FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey "
        "UNION ALL SELECT CAST(o_custkey AS VARCHAR), count(*), 2 FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey",
        ""),
    "hindex": (
        "SELECT auid, hindex FROM (SELECT auid, hindex, rank() OVER (PARTITION BY auid ORDER BY src DESC, hindex DESC) AS rnk "
        "FROM snapshots) WHERE rnk = 1", "snapshots"),
    "authority_requests": (
        "SELECT c_mktsegment AS issn, CAST(o_custkey * (o_orderkey % 2 + 1) AS VARCHAR) AS auid "
        "FROM orders JOIN customer ON c_custkey = o_custkey", ""),
    "journal_authors": ("SELECT c_mktsegment AS issn, CAST(c_custkey AS VARCHAR) AS auid FROM customer", ""),
    "ptiles": (
        "SELECT DISTINCT j.issn, h.hindex, percent_rank() OVER (PARTITION BY j.issn ORDER BY h.hindex) AS ptile "
        "FROM journal_authors j JOIN hindex h ON j.auid = h.auid", "journal_authors hindex"),
    "author_names": (
        "SELECT CAST(l_suppkey AS VARCHAR) AS auid, 'N' || (l_partkey % (1 + l_suppkey % 4)) AS indexed_name FROM lineitem", ""),
    "ambiguity": (
        "SELECT auid, count(DISTINCT indexed_name) - 1 AS ambiguity FROM author_names GROUP BY auid", "author_names"),
    "clear": ("SELECT auid FROM ambiguity WHERE ambiguity <= 1", "ambiguity"),
    "paper_authors": (
        "SELECT CAST(l_orderkey AS VARCHAR) AS eid, 'J' || (o_custkey % 50) AS issn, CAST(l_suppkey AS VARCHAR) AS auid "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey", ""),
    "clear_authors": ("SELECT a.* FROM paper_authors a JOIN clear c ON a.auid = c.auid", "paper_authors clear"),
    "reached": (
        "SELECT eid, auid FROM paper_authors WHERE eid IN (SELECT eid FROM paper_authors WHERE auid IN "
        "(SELECT auid FROM paper_authors WHERE issn = 'J7'))", "paper_authors"),
    "clear_links": (
        "SELECT DISTINCT a.auid AS src, b.auid AS dst, CAST(1 AS BIGINT) AS w FROM reached a JOIN reached b "
        "ON a.eid = b.eid AND a.auid <> b.auid WHERE a.auid IN (SELECT auid FROM clear) "
        "AND b.auid IN (SELECT auid FROM clear)", "reached clear"),
    "links": (
        "SELECT a.auid AS src, b.auid AS dst, count(*) AS w FROM reached a JOIN reached b "
        "ON a.eid = b.eid AND a.auid <> b.auid GROUP BY a.auid, b.auid", "reached"),
    "earlier": (
        "SELECT DISTINCT a.eid, a.issn, b.eid AS eid_asc FROM dated_authors a JOIN dated_authors b "
        "ON a.auid = b.auid AND a.year >= b.year WHERE a.eid IN (SELECT id FROM vectors) "
        "AND b.eid IN (SELECT id FROM vectors)", "dated_authors vectors"),
    "trend": (
        "SELECT eid, issn, d2_diff, percent_rank() OVER (PARTITION BY issn ORDER BY d2_diff) AS ptile FROM ("
        f"SELECT p.id AS eid, p.issn, {_d2('p.embedding', 'two.embedding')} - {_d2('p.embedding', 'one.embedding')} AS d2_diff "
        "FROM paper_vectors p JOIN year_centroids one ON one.issn = p.issn AND one.year = p.year - 1 "
        "JOIN year_centroids two ON two.issn = p.issn AND two.year = p.year - 2) WHERE d2_diff > 0",
        "paper_vectors year_centroids"),
    "text_trend": (
        "SELECT eid, issn, d2_diff, percent_rank() OVER (PARTITION BY issn ORDER BY d2_diff) AS ptile FROM ("
        f"SELECT p.id AS eid, p.issn, {_d2('p.embedding', 'two.embedding')} - {_d2('p.embedding', 'one.embedding')} AS d2_diff "
        "FROM text_paper_vectors p JOIN text_year_centroids one ON one.issn = p.issn AND one.year = p.year - 1 "
        "JOIN text_year_centroids two ON two.issn = p.issn AND two.year = p.year - 2) WHERE d2_diff > 0",
        "text_paper_vectors text_year_centroids"),
    # Standard normal distribution by its series, in logarithms; n = 0..200.
    "odd_factorials": (
        "SELECT n, sum(ln(2 * n + 1)) OVER (ORDER BY n) AS ln_odd FROM (SELECT unnest(range(201)) AS n)", ""),
}


def _scope_parts(vectors: str) -> dict[str, tuple[str, str]]:
    """Parts of scope matching over sent(query_id, target_issn, embedding, exclude)."""
    return {
        "siblings": (
            "SELECT s.query_id, s.target_issn, s.embedding, p.eid, p.issn FROM sent s "
            "JOIN journal_areas j ON s.target_issn = j.issn "
            "JOIN papers p ON list_has_any(p.subjareas, j.areas) AND p.eid <> s.exclude", "journal_areas papers"),
        "ref": ("SELECT query_id, issn, count(*) AS n_ref FROM siblings GROUP BY query_id, issn", ""),
        "near": (
            "SELECT * FROM (SELECT b.query_id, b.issn, row_number() OVER (PARTITION BY b.query_id ORDER BY "
            f"{_d2('b.embedding', 'v.embedding')}, v.id) AS rnk FROM siblings b JOIN {vectors} v ON b.eid = v.id) "
            "WHERE rnk <= 20", vectors),
        "test": ("SELECT query_id, issn, count(*) AS n_test FROM near GROUP BY query_id, issn", ""),
        "shares": (
            "SELECT t.query_id, t.issn, r.n_ref, t.n_test, rt.total_ref, tt.total_test, "
            "n_ref / total_ref AS share_ref, n_test / total_test AS share_test FROM test t "
            "JOIN ref r ON r.query_id = t.query_id AND r.issn = t.issn "
            "JOIN (SELECT query_id, sum(n_ref) AS total_ref FROM ref GROUP BY query_id) rt ON rt.query_id = t.query_id "
            "JOIN (SELECT query_id, sum(n_test) AS total_test FROM test GROUP BY query_id) tt ON tt.query_id = t.query_id", ""),
        "z": (
            "SELECT *, CASE WHEN v > 0 THEN (share_test - share_ref) / sqrt(v) END AS z FROM (SELECT *, "
            "share_ref * (1 - share_ref) / total_ref + share_test * (1 - share_test) / total_test AS v FROM shares)", ""),
        "phi": (
            "SELECT query_id, issn, exp(-z * z / 2) * 2 / sqrt(pi()) * sum(exp(n * ln(2) + (2 * n + 1) * ln(z / sqrt(2)) - ln_odd)) "
            "AS erf FROM z, odd_factorials WHERE z > 0 AND z < 6 * sqrt(2) GROUP BY query_id, issn, z", "odd_factorials"),
        "scores": (
            "SELECT z.*, CASE WHEN z.z IS NULL OR z.z <= 0 THEN 0 WHEN z.z >= 6 * sqrt(2) THEN 1 ELSE phi.erf END AS score "
            "FROM z LEFT JOIN phi ON phi.query_id = z.query_id AND phi.issn = z.issn", ""),
    }


def _with(parts: str, select: str, extra: dict[str, tuple[str, str]] | None = None) -> str:
    extra = extra or {}
    needed: set[str] = set()

    def need(name: str) -> None:
        if name not in needed:
            body = extra.get(name) or _PARTS[name]
            for other in body[1].split():
                need(other)
            needed.add(name)

    for name in [*parts.split(), *extra]:
        need(name)
    ordered = [n for n in [*_PARTS, *extra] if n in needed]
    bodies = ", ".join(f"{n} AS ({(extra.get(n) or _PARTS[n])[0]})" for n in ordered)
    recursive = "RECURSIVE " if "ranks" in extra else ""
    return f"WITH {recursive}{bodies} {select}"


def _pagerank(links: str, rounds: int = 20, digits: int = 6) -> str:
    extra = {
        "edges": (
            f"SELECT l.src, l.dst, l.w / o.w AS share FROM {links} l JOIN "
            f"(SELECT src, sum(w) AS w FROM {links} GROUP BY src) o ON o.src = l.src", links),
        "ranks": (
            "SELECT 0 AS round, auid, CAST(1 AS DOUBLE) AS rank FROM (SELECT DISTINCT src AS auid FROM edges) UNION ALL "
            "SELECT r.round + 1, e.dst, CAST(0.15 AS DOUBLE) + CAST(0.85 AS DOUBLE) * sum(r.rank * e.share) "
            f"FROM ranks r JOIN edges e ON e.src = r.auid WHERE r.round < {rounds} GROUP BY r.round + 1, e.dst", ""),
    }
    return _with(links, f"SELECT auid, {r6('rank', 'pageRank', digits)} FROM ranks WHERE round = {rounds}", extra)


def _scope(sent: tuple[str, str], vectors: str, select: str) -> str:
    return _with("papers", select, {"sent": sent, **_scope_parts(vectors)})


def _trending(reference: str, centroids: str, sent: str, uses: str) -> str:
    """Scores of sent(query_id, issn, year, embedding)."""
    extra = {
        "sent": (sent, uses),
        "dated": (
            f"SELECT s.query_id, {_d2('s.embedding', 'c.embedding')} AS d2, "
            f"row_number() OVER (PARTITION BY s.query_id ORDER BY c.year DESC) AS age "
            f"FROM sent s JOIN {centroids} c ON c.issn = s.issn AND c.year < s.year", centroids),
        "diffs": (
            "SELECT s.query_id, s.issn, two.d2 - one.d2 AS d2_diff FROM sent s "
            "LEFT JOIN dated one ON one.query_id = s.query_id AND one.age = 1 "
            "LEFT JOIN dated two ON two.query_id = s.query_id AND two.age = 2", ""),
    }
    return _with(reference, (
        f"SELECT query_id, issn, {r6('d2_diff', 'd2_diff')}, {r6('p', 'trending')} FROM ("
        "SELECT d.query_id, d.issn, d.d2_diff, CASE WHEN d.d2_diff IS NULL THEN NULL "
        f"WHEN NOT EXISTS (SELECT 1 FROM {reference} t WHERE t.issn = d.issn AND t.d2_diff >= d.d2_diff) THEN 1 "
        f"ELSE coalesce((SELECT max(t.ptile) FROM {reference} t WHERE t.issn = d.issn AND t.d2_diff < d.d2_diff), 0) END AS p "
        "FROM diffs d)"
    ), extra)


def _nearest(order: str, k: int, rank_by: str = "query_id") -> str:
    return (
        f"SELECT query_id, id, {r6('d2', 'd2')}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {rank_by} "
        f"ORDER BY {order}) AS INTEGER) AS rank FROM pairs) WHERE rank <= {k}"
    )


_COMPLETE = "title IS NOT NULL"
_DATED = f"{_COMPLETE} AND regexp_matches(datesort, '{_DATE_PATTERN}')"
_CONTENT = f"eid, issn, title, abstr, {_areas('subjareas')}, lang AS publishername, 'Journal ' || issn AS sourcetitle, issn AS sourcetitle_abbrev"
_BOW = "SELECT id, term, " + r6("weight", "weight", 9) + " FROM {}"
_OWN = ("SELECT id AS query_id, issn AS target_issn, embedding, id AS exclude FROM paper_vectors", "paper_vectors")
_SENT = (
    "SELECT s.query_id, s.target_issn, v.embedding, '' AS exclude FROM submissions s JOIN submission_vectors v "
    "ON v.id = s.query_id", "submissions submission_vectors")
_VALUE = (
    f"SELECT s.query_id, s.target_issn, {r6('coalesce(c.score, CASE WHEN j.issn IS NOT NULL THEN 0 END)', 'value')} "
    "FROM sent s LEFT JOIN scores c ON c.query_id = s.query_id AND c.issn = s.target_issn "
    "LEFT JOIN journal_areas j ON j.issn = s.target_issn"
)
_CONTRAST = {
    "wanted": (
        "SELECT p.eid, p.subjareas, c.embedding FROM papers p JOIN centroids c ON c.issn = p.issn", "papers centroids"),
    "pairs": (
        f"SELECT w.eid AS query_id, v.id, {_d2('w.embedding', 'v.embedding')} AS d2 FROM wanted w "
        "JOIN paper_vectors v ON list_has_any(v.subjareas, w.subjareas)", "paper_vectors"),
}
_FREQ = "SELECT term AS token, {} AS freq FROM all_tokens GROUP BY term"
_TERMS = "SELECT id, CAST(sentence AS INTEGER) AS sentence, CAST(pos AS INTEGER) AS pos, term FROM {}"
_JOURNAL_PAIRS = {"pairs": ("SELECT * FROM journal_distances", "journal_distances")}
_METRICS = (
    "SELECT *, cases - positives AS negatives, cases - predicted_positives AS predicted_negatives, "
    "predicted_positives - true_positives AS false_positives, cases - predicted_positives - true_negatives AS false_negatives "
    "FROM (SELECT doc_id % 4 AS set, count(*) AS cases, count(*) FILTER (quality = 1) AS positives, "
    "count(*) FILTER (toxic = 1) AS predicted_positives, count(*) FILTER (quality = 1 AND toxic = 1) AS true_positives, "
    "count(*) FILTER (quality = 0 AND toxic = 0) AS true_negatives FROM labels GROUP BY doc_id % 4)"
)

ORACLES: dict[str, str] = {
    "clean_content": _with("raw", f"SELECT DISTINCT {_CONTENT}, CAST(datesort[1:4] AS INTEGER) AS year, "
                                  f"CAST(datesort[5:6] AS INTEGER) AS month FROM raw WHERE {_DATED}"),
    "clean_content_no_dates": _with("raw", f"SELECT DISTINCT {_CONTENT} FROM raw WHERE {_COMPLETE}"),
    "paper_authors_explode": _with("raw_authors", "SELECT eid, issn, auid FROM raw_authors"),
    "author_columns_explode": _with("raw_authors", (
        "SELECT eid, auid, surname, indexed_name, " + ", ".join(
            f"CAST(NULL AS VARCHAR) AS {c}"
            for c in ("orcid", "given_name", "given_name_pn", "surname_pn", "nametext", "e_address_type"))
        + " FROM raw_authors")),
    "author_ids_explode": _with("raw_authors", "SELECT eid, auid FROM raw_authors"),
    "issn_author_pairs": _with("raw_authors", "SELECT DISTINCT issn, auid FROM raw_authors"),
    "valid_paper_authors": _with("raw_authors", (
        f"SELECT DISTINCT eid, issn, {_areas('subjareas')}, CAST(datesort[1:4] AS INTEGER) AS year, "
        f"CAST(datesort[5:6] AS INTEGER) AS month, auid FROM raw_authors WHERE {_DATED}")),
    "subject_areas_explode": _with("areas", "SELECT eid, area FROM areas"),
    "papers_sharing_area": _with("papers", f"SELECT eid, issn, {_areas('subjareas')} FROM papers "
                                           "WHERE list_has_any(subjareas, ['A1', 'de'])"),
    "papers_not_in_journals": _with("papers", f"SELECT eid, issn FROM papers WHERE issn NOT IN {JOURNALS}"),
    "area_frequencies": _with("areas", (
        f"SELECT area, count(*) AS freq, {r6('count(*) * 100.0 / (SELECT count(*) FROM papers)', 'pct')} FROM areas GROUP BY area")),
    "journal_distribution": _with("papers", (
        f"SELECT sourcetitle, count(*) AS count, {r6('count(*) * 100.0 / (SELECT count(*) FROM papers)', 'pct')} "
        "FROM papers GROUP BY sourcetitle")),
    "subject_area_histogram": _with("areas", "SELECT area AS subjectarea, count(*) AS count FROM areas GROUP BY area"),
    "journal_subject_areas": _with("journal_areas", f"SELECT issn, {_areas('areas')} FROM journal_areas"),
    "references_dedupe": (
        "SELECT DISTINCT strftime(o_orderdate, '%Y%m%d') AS datesort, 'J' || (o_custkey % 50) AS issn, "
        "CAST(l_orderkey AS VARCHAR) AS eid, CAST(l_partkey AS VARCHAR) AS reference "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "mask_numeric_expressions": _with("papers", f"SELECT eid, {_masked('abstr')} AS abstr FROM papers"),
    "tokenize_sentences": _with("abstract_tokens", _TERMS.format("abstract_tokens")),
    "mask_lower_tokenize": _with("", _TERMS.format("masked_tokens"), {
        "masked": (f"SELECT eid, lower({_masked('abstr')}) AS body FROM papers", "papers"),
        "masked_tokens": (_tokenized("masked", "eid", "body"), ""),
    }),
    "tokenize_texts_lower": _with("submission_tokens", (
        "SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY sentence, pos) - 1 AS INTEGER) AS pos, "
        "lower(term) AS term FROM submission_tokens")),
    "term_frequency": _with("all_tokens", _FREQ.format("count(*)")),
    "doc_frequency": _with("all_tokens", _FREQ.format("count(DISTINCT id)")),
    "doc_frequency_of_papers": _with("all_tokens", _FREQ.format("count(DISTINCT id)")),
    "idf_weights_of_papers": _with("idf", f"SELECT token, {r6('weight', 'weight')} FROM idf"),
    "idf_weights": _with("idf", f"SELECT token, {r6('weight', 'weight')} FROM idf"),
    "tfidf_bow": _with("bow", _BOW.format("bow")),
    "word2vec_vectors": _with("abstract_tokens", (
        f"SELECT term AS word, CAST({D} AS INTEGER) AS dimension FROM abstract_tokens GROUP BY term HAVING count(*) >= 5")),
    "tfidf_maps": _with("bow", _BOW.format("bow")),
    "submission_bow": _with("submission_bow", _BOW.format("submission_bow")),
    "paper_embedding_weighted_mean": _with("text_vectors", _long("text_vectors", "id", W)),
    "paper_embedding_from_texts": _with("text_vectors", _long("text_vectors", "id", W)),
    "submission_embedding": _with("submission_vectors", (
        "SELECT id AS query_id, pos, value FROM (" + _long("submission_vectors", "id", W) + ")")),
    "l2_all_pairs_to_queries": _with("journal_distances", f"SELECT query_id, id, {r6('d2', 'd2')} FROM journal_distances"),
    "knn_papers": _with("vectors", _nearest("d2, id", 5), {
        "pairs": (f"SELECT q.id AS query_id, v.id, {_d2('q.embedding', 'v.embedding')} AS d2 FROM vectors q, vectors v", "")}),
    "knn_to_journals": _with("", _nearest("d2, id", 10), _JOURNAL_PAIRS),
    "k_farthest": _with("", _nearest("d2 DESC, id", 10), _JOURNAL_PAIRS),
    "k_best_by_order": _with("", _nearest("floor(d2 * 10), id DESC", 7), _JOURNAL_PAIRS),
    "journal_centroids": _with("centroids", "SELECT issn AS id, pos, value FROM (" + _long("centroids", "issn", D) + ")"),
    "journal_centroids_from_years": _with("centroids", "SELECT issn AS id, pos, value FROM (" + _long("centroids", "issn", D) + ")"),
    "journal_year_centroids": _with("year_centroids", (
        "SELECT issn AS id, year, pos, value FROM (" + _long("year_centroids", "issn, year", D) + ")")),
    "journal_centroids_with_areas": _with("centroids journal_areas", (
        f"SELECT c.issn AS id, array_to_string(a.areas, ',') AS subjareas, pos, value "
        f"FROM ({_long('centroids', 'issn', D)}) c JOIN journal_areas a ON a.issn = c.issn")),
    "journal_year_centroids_with_areas": _with("year_centroids journal_areas", (
        f"SELECT c.issn AS id, year, array_to_string(a.areas, ',') AS subjareas, pos, value "
        f"FROM ({_long('year_centroids', 'issn, year', D)}) c JOIN journal_areas a ON a.issn = c.issn")),
    "area_index": _with("area_index", "SELECT area, areaIndex FROM area_index"),
    "area_onehot": _with("areas area_index vectors", (
        "SELECT l.id, f.flags, l.pos, l.value FROM (" + _long("vectors", "id", D) + ") l JOIN ("
        "SELECT eid, string_agg(CAST(flag AS VARCHAR), '' ORDER BY slot) AS flags FROM ("
        "SELECT a.eid, s.slot, max(CASE WHEN i.areaIndex = s.slot THEN 1 ELSE 0 END) AS flag FROM areas a "
        "JOIN area_index i ON i.area = a.area, (SELECT unnest(range(27)) AS slot) s GROUP BY a.eid, s.slot) GROUP BY eid) f "
        "ON f.eid = l.id")),
    "issn_freq_for_areas": _with("areas", f"SELECT issn, count(*) AS count FROM areas WHERE area IN {AREAS} GROUP BY issn"),
    "journal_index": _with("journal_index", "SELECT issn, index FROM journal_index"),
    "journal_onehot": _with("journal_index papers", (
        "SELECT p.eid AS id, CAST(s.slot AS INTEGER) AS slot, CAST(j.index = s.slot AS INTEGER) AS flag FROM papers p "
        "JOIN journal_index j ON j.issn = p.issn, (SELECT unnest(range((SELECT count(*) FROM journal_index))) AS slot) s")),
    "classifier_metrics": (
        "SELECT set, cases, positives, predicted_positives, true_positives, true_negatives, negatives, predicted_negatives, "
        f"false_positives, false_negatives, {r6('(true_positives + true_negatives) / cases', 'accuracy')}, "
        f"{r6('positives / cases', 'prevalence')}, {r6('true_positives / nullif(positives, 0)', 'recall')}, "
        f"{r6('true_negatives / nullif(negatives, 0)', 'specificity')}, {r6('true_positives / nullif(predicted_positives, 0)', 'ppv')}, "
        f"{r6('true_negatives / nullif(predicted_negatives, 0)', 'npv')} FROM ({_METRICS})"),
    "latest_hindex": _with("hindex", "SELECT auid, hindex FROM hindex"),
    "hindex_percentile_by_journal": _with("ptiles", f"SELECT issn, hindex, {r6('ptile', 'ptile')} FROM ptiles"),
    "journal_hindex_percent_rank": _with("journal_authors hindex", (
        f"SELECT issn, auid, hindex, {r6('p', 'ptile')} FROM (SELECT j.issn, j.auid, h.hindex, "
        "percent_rank() OVER (PARTITION BY j.issn ORDER BY h.hindex) AS p FROM journal_authors j JOIN hindex h ON j.auid = h.auid)")),
    "academic_authority": _with("authority_requests hindex ptiles", (
        f"SELECT issn, auid, hindex, {r6('p', 'authority')} FROM (SELECT j.issn, j.auid, h.hindex, CASE WHEN h.hindex IS NULL THEN NULL "
        "WHEN NOT EXISTS (SELECT 1 FROM ptiles t WHERE t.issn = j.issn AND t.hindex >= h.hindex) THEN 1 "
        "ELSE coalesce((SELECT max(t.ptile) FROM ptiles t WHERE t.issn = j.issn AND t.hindex < h.hindex), 0) END AS p "
        "FROM authority_requests j LEFT JOIN hindex h ON h.auid = j.auid)")),
    "percentile_normalize": _with("ptiles", (
        f"SELECT c_custkey, issn, {r6('p', 'normalized')} FROM (SELECT c_custkey, c_mktsegment AS issn, "
        "CASE WHEN NOT EXISTS (SELECT 1 FROM ptiles t WHERE t.issn = c_mktsegment AND t.hindex >= c_acctbal / 100) THEN 1 "
        "ELSE coalesce((SELECT max(t.ptile) FROM ptiles t WHERE t.issn = c_mktsegment AND t.hindex < c_acctbal / 100), 0) END AS p "
        "FROM customer)")),
    "author_ambiguity": _with("ambiguity", "SELECT auid, ambiguity FROM ambiguity"),
    "unambiguous_authors": _with("clear", "SELECT auid FROM clear"),
    "coauthor_pairs": _with("paper_authors", (
        'SELECT a.auid AS "left", b.auid AS "right" FROM paper_authors a JOIN paper_authors b '
        "ON a.eid = b.eid AND a.auid <> b.auid")),
    "coauthor_pairs_distinct": _with("clear_authors", (
        'SELECT DISTINCT a.auid AS "left", b.auid AS "right" FROM clear_authors a JOIN clear_authors b '
        "ON a.eid = b.eid AND a.auid <> b.auid")),
    "coauthors_with_papers": _with("clear_authors", (
        'SELECT a.eid, a.issn, a.auid AS "left", b.auid AS "right" FROM clear_authors a JOIN clear_authors b '
        "ON a.eid = b.eid AND a.auid <> b.auid")),
    "coauthors_by_journal": _with("clear_authors paper_authors", (
        'SELECT DISTINCT a.issn, a.auid AS "left", b.auid AS "right" FROM clear_authors a JOIN clear_authors b '
        "ON a.eid = b.eid AND a.auid <> b.auid WHERE a.issn IN ('J7', 'J8') AND a.eid IN (SELECT eid FROM paper_authors "
        "WHERE auid IN (SELECT auid FROM paper_authors WHERE issn IN ('J7', 'J8')))")),
    "papers_reachable_from_journal": _with("papers dated_authors", (
        "SELECT eid, issn FROM papers WHERE eid IN (SELECT eid FROM dated_authors WHERE auid IN "
        "(SELECT auid FROM dated_authors WHERE issn = 'src1'))")),
    "authors_reachable": _with("dated_authors", (
        "SELECT eid, auid FROM dated_authors WHERE eid IN (SELECT eid FROM dated_authors WHERE auid IN "
        "(SELECT auid FROM dated_authors WHERE issn = 'src1'))")),
    "cojournal_counts": _with("clear_authors", (
        'SELECT a.issn AS "left", b.issn AS "right", count(*) AS count FROM (SELECT DISTINCT issn, auid FROM clear_authors) a '
        "JOIN (SELECT DISTINCT issn, auid FROM clear_authors) b ON a.auid = b.auid GROUP BY a.issn, b.issn")),
    "coauthor_pagerank_fixed": _pagerank("clear_links"),
    "coauthor_pagerank_repeated_fixed": _pagerank("links"),
    # So many rounds that further ones change nothing in the given decimals.
    "coauthor_pagerank_converged": _pagerank("links", rounds=150, digits=4),
    "originality_pairs": _with("earlier vectors", (
        f"SELECT eid, issn, eid_asc, CAST(pos AS INTEGER) AS pos, {r6('x', 'value')}, {r6('y', 'value_asc')} FROM ("
        f"SELECT e.eid, e.issn, e.eid_asc, unnest(range({D})) AS pos, unnest(a.embedding) AS x, unnest(b.embedding) AS y "
        "FROM earlier e JOIN vectors a ON a.id = e.eid JOIN vectors b ON b.id = e.eid_asc)")),
    "originality_pairs_strict": _with("dated_authors vectors", (
        "SELECT DISTINCT a.eid, a.issn, b.eid AS eid_asc FROM dated_authors a JOIN dated_authors b ON a.auid = b.auid "
        "AND (a.year > b.year OR (a.year = b.year AND a.month > b.month)) WHERE a.eid IN (SELECT id FROM vectors) "
        "AND b.eid IN (SELECT id FROM vectors)")),
    "originality_distances": _with("earlier vectors", (
        f"SELECT e.eid, e.issn, e.eid_asc, {r6(_d2('a.embedding', 'b.embedding'), 'd2')} FROM earlier e "
        "JOIN vectors a ON a.id = e.eid JOIN vectors b ON b.id = e.eid_asc")),
    "trending_reference": _with("trend", f"SELECT eid, issn, {r6('d2_diff', 'd2_diff')}, {r6('ptile', 'ptile')} FROM trend"),
    "trending_scores": _trending(
        "trend", "year_centroids", "SELECT id AS query_id, issn, year, embedding FROM paper_vectors", "paper_vectors"),
    "trending_for_texts": _trending(
        "text_trend", "text_year_centroids",
        "SELECT s.query_id, s.target_issn AS issn, s.year, v.embedding FROM submissions s JOIN submission_vectors v "
        "ON v.id = s.query_id", "submissions submission_vectors"),
    "reference_histogram": _scope(_OWN, "vectors", (
        f"SELECT query_id, issn, n_ref, {r6('n_ref / sum(n_ref) OVER (PARTITION BY query_id)', 'share_ref')} FROM ref")),
    "neighbor_histogram": _scope(_OWN, "vectors", (
        f"SELECT query_id, issn, n_test, {r6('n_test / sum(n_test) OVER (PARTITION BY query_id)', 'share_test')} FROM test")),
    "scope_match_scores": _scope(_OWN, "vectors", (
        "SELECT c.query_id, s.target_issn, c.issn, c.n_ref, CAST(c.total_ref AS BIGINT) AS total_ref, c.n_test, "
        f"CAST(c.total_test AS BIGINT) AS total_test, {r6('c.score', 'score')} FROM scores c JOIN sent s ON s.query_id = c.query_id")),
    "scope_match_value": _scope(_OWN, "vectors", _VALUE),
    "scope_match_histograms": _scope(_OWN, "vectors", (
        f"SELECT r.query_id, r.issn, r.n_ref, {r6('r.n_ref / sum(r.n_ref) OVER (PARTITION BY r.query_id)', 'share_ref')}, "
        f"c.n_test, {r6('c.share_test', 'share_test')}, {r6('c.score', 'score')} FROM ref r "
        "LEFT JOIN scores c ON c.query_id = r.query_id AND c.issn = r.issn")),
    "scope_contrast_papers": _with("", (
        "SELECT query_id AS eid, id, d2, rank FROM (" + _nearest("d2, id", 5) + ")"), _CONTRAST),
    "scope_match_for_texts": _scope(_SENT, "text_vectors", _VALUE),
}
_RATES = ORACLES["classifier_metrics"]
ORACLES |= {
    "vector_arithmetic": _with("vectors", (
        "SELECT id, pos, value FROM (" + _long(
            "(SELECT id, list_transform(embedding, lambda x: (x * 3 + x) / 8) AS embedding FROM vectors)", "id", D) + ")")),
    "merged_evaluations": _RATES.replace("doc_id % 4", "doc_id % 2"),
    "hindex_copies_dropped": (
        "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS auid, CAST(l_partkey % 50 AS INTEGER) AS hindex FROM lineitem"),
    "ordered_hindex_distribution": _with("ptiles", (
        "SELECT CAST(row_number() OVER (ORDER BY issn, ptile) - 1 AS INTEGER) AS place, issn, CAST(hindex AS DOUBLE) AS hindex, "
        f"{r6('ptile', 'ptile')} FROM ptiles")),
    "distribution_of_one_journal": _with("ptiles", (
        f"SELECT CAST(hindex AS DOUBLE) AS value, {r6('ptile', 'ptile')} FROM ptiles WHERE issn = 'BUILDING'")),
    "coauthors_written_by_journal": ORACLES["coauthors_by_journal"],
    "trending_reference_of_one_journal": _with("trend", (
        f"SELECT {r6('d2_diff', 'value')}, {r6('ptile', 'ptile')} FROM trend WHERE issn = 'src1'")),
}
ORACLES["originality_distances_by_author"] = ORACLES["originality_distances"]
ORACLES["knn_papers_by_index"] = ORACLES["knn_papers"]
ORACLES["neighbor_histogram_by_index"] = ORACLES["neighbor_histogram"]
ORACLES["journal_onehot_sparse"] = _with("journal_index papers", (
    "SELECT p.eid AS id, CAST((SELECT count(*) FROM journal_index) AS INTEGER) AS size, j.index AS slot "
    "FROM papers p JOIN journal_index j ON j.issn = p.issn"))


def _fitted(points: str, labels: str, steps: int = 20, rate: float = 2.0) -> dict[str, tuple[str, str]]:
    """Logistic regressions by gradient steps: fitted(slot, id, train, y, hit) from points(id, features) and
    labels(id, slot, y). Four fifths of the ids, by hash, train."""
    parts = {
        "lr_points": (f"SELECT id, features, substr(sha256('1:' || id), 1, 8) <= 'cccccccc' AS train FROM ({points})", ""),
        "lr_labels": (labels, ""),
        "lr_long": (f"SELECT id, train, unnest(range(1, {D + 1})) AS pos, unnest(features) AS x FROM lr_points", ""),
        "lr_scales": ("SELECT pos, avg(x) AS m, stddev_samp(x) AS s FROM lr_long WHERE train GROUP BY pos", ""),
        "lr_x": ("SELECT id, train, l.pos, (x - m) / CASE WHEN s > 0 THEN s ELSE 1 END AS x FROM lr_long l "
                 "JOIN lr_scales c ON c.pos = l.pos UNION ALL SELECT id, train, 0, 1 FROM lr_points", ""),
        "lr_w0": (f"SELECT slot, pos, CAST(0 AS DOUBLE) AS w FROM (SELECT DISTINCT slot FROM lr_labels), "
                  f"(SELECT unnest(range({D + 1})) AS pos)", ""),
    }
    for t in range(steps):
        parts[f"lr_r{t}"] = (
            f"SELECT l.slot, l.id, any_value(y) - 1 / (1 + exp(-sum(w * x))) AS r FROM lr_labels l "
            f"JOIN lr_w{t} w ON w.slot = l.slot JOIN lr_x x ON x.id = l.id AND x.pos = w.pos WHERE train GROUP BY l.slot, l.id", "")
        parts[f"lr_w{t + 1}"] = (
            f"SELECT w.slot, w.pos, w + {rate} * g AS w FROM lr_w{t} w JOIN (SELECT slot, pos, avg(r * x) AS g FROM lr_r{t} r "
            f"JOIN lr_x x ON x.id = r.id GROUP BY slot, pos) g ON g.slot = w.slot AND g.pos = w.pos", "")
    parts["lr_fitted"] = (
        f"SELECT slot, id, train, y, CASE WHEN z > 0 THEN 1 ELSE 0 END AS hit FROM (SELECT l.slot, l.id, train, any_value(y) AS y, "
        f"sum(w * x) AS z FROM lr_labels l JOIN lr_w{steps} w ON w.slot = l.slot JOIN lr_x x ON x.id = l.id AND x.pos = w.pos "
        f"GROUP BY l.slot, l.id, train)", "")
    return parts


def _learned(needed: str, points: str, labels: str, select: str) -> str:
    """Parts that the points need, then the fit, each computed once."""
    head = _with(needed, "SELECT 1")
    head = head[:head.rindex("SELECT 1")].rstrip()
    fit = ", ".join(f"{name} AS MATERIALIZED ({body})" for name, (body, _) in _fitted(points, labels).items())
    return f"{head}, {fit} {select}"


_AREA_POINTS = "SELECT v.id, v.embedding AS features FROM vectors v WHERE v.id IN (SELECT eid FROM areas)"
_AREA_LABELS = (
    "SELECT v.id, i.areaIndex AS slot, CAST(max(CASE WHEN a.area = i.area THEN 1 ELSE 0 END) AS DOUBLE) AS y "
    "FROM vectors v JOIN areas a ON a.eid = v.id, area_index i {} GROUP BY v.id, i.areaIndex")
_FIRST_AREA = _AREA_LABELS.format("WHERE i.areaIndex = 0")
_HITS = "count(*) FILTER (y = hit)"
ORACLES["area_lr_accuracy"] = _learned("areas area_index vectors", _AREA_POINTS, _FIRST_AREA, (
    f"SELECT 0 AS areaIndex, {_HITS} AS fitcount, count(*) AS totalcount FROM lr_fitted WHERE NOT train"))
ORACLES["all_areas_lr"] = _learned("areas area_index vectors", _AREA_POINTS, _AREA_LABELS.format(""), (
    f"SELECT i.area AS label, fitcount, totalcount, {r6('100 * fitcount / totalcount', 'accuracy')} FROM (SELECT slot, "
    f"{_HITS} AS fitcount, count(*) AS totalcount FROM lr_fitted WHERE NOT train GROUP BY slot) f "
    "JOIN area_index i ON i.areaIndex = f.slot"))
ORACLES["area_lr_evaluation"] = _learned("areas area_index vectors", _AREA_POINTS, _FIRST_AREA, (
    "SELECT set, cases, positives, predicted_positives, true_positives, true_negatives, negatives, predicted_negatives, "
    f"false_positives, false_negatives, {r6('(true_positives + true_negatives) / cases', 'accuracy')}, "
    f"{r6('positives / cases', 'prevalence')}, {r6('true_positives / nullif(positives, 0)', 'recall')}, "
    f"{r6('true_negatives / nullif(negatives, 0)', 'specificity')}, {r6('true_positives / nullif(predicted_positives, 0)', 'ppv')}, "
    f"{r6('true_negatives / nullif(predicted_negatives, 0)', 'npv')} FROM ("
    "SELECT *, cases - positives AS negatives, cases - predicted_positives AS predicted_negatives, "
    "predicted_positives - true_positives AS false_positives, cases - predicted_positives - true_negatives AS false_negatives "
    "FROM (SELECT CASE WHEN train THEN 'training' ELSE 'testing' END AS set, count(*) AS cases, "
    "count(*) FILTER (y = 1) AS positives, count(*) FILTER (hit = 1) AS predicted_positives, "
    "count(*) FILTER (y = 1 AND hit = 1) AS true_positives, count(*) FILTER (y = 0 AND hit = 0) AS true_negatives "
    "FROM lr_fitted GROUP BY train))"))
# Fitted on the listed journals; the papers of the areas in other journals are judged by the same weights.
ORACLES["journal_one_vs_others"] = _learned(
    "areas vectors papers",
    f"SELECT v.id, v.embedding AS features FROM vectors v JOIN papers p ON p.eid = v.id WHERE p.issn IN {JOURNALS}",
    "SELECT p.eid AS id, 0 AS slot, CAST(CASE WHEN p.issn = 'src1' THEN 1 ELSE 0 END AS DOUBLE) AS y "
    f"FROM papers p JOIN vectors v ON v.id = p.eid WHERE p.issn IN {JOURNALS}",
    f"SELECT (SELECT {_HITS} FROM lr_fitted WHERE NOT train) AS fitcount, "
    "(SELECT count(*) FROM lr_fitted WHERE NOT train) AS totalcount, "
    "count(*) FILTER (z <= 0) AS complement_fitcount, count(*) AS complement_totalcount FROM ("
    "SELECT o.id, o.n, sum(w.w * CASE WHEN w.pos = 0 THEN 1 ELSE (v.embedding[w.pos] - c.m) / CASE WHEN c.s > 0 THEN c.s ELSE 1 END END) AS z "
    "FROM (SELECT a.eid AS id, row_number() OVER (ORDER BY a.eid, a.area) AS n FROM areas a "
    f"JOIN papers p ON p.eid = a.eid WHERE a.area IN {AREAS} AND p.issn NOT IN {JOURNALS}) o "
    "JOIN vectors v ON v.id = o.id CROSS JOIN lr_w20 w LEFT JOIN lr_scales c ON c.pos = w.pos GROUP BY o.id, o.n)")

# --- what builds store, by the rules of their operators
_RAW_CLEAR = {
    "raw_clear": (
        "SELECT eid, issn, auid FROM raw_authors WHERE auid IN ("
        "SELECT auid FROM raw_authors GROUP BY auid HAVING count(DISTINCT indexed_name) - 1 <= 4)", "raw_authors"),
}
_RAW_HINDEX = {
    "raw_numbers": ("SELECT DISTINCT auid, CAST(substr(auid, 2) AS BIGINT) AS n FROM raw_authors", "raw_authors"),
    "raw_hindex": ("SELECT auid, CASE WHEN n % 2 = 0 THEN n % 11 ELSE n * 3 % 17 END AS hindex FROM raw_numbers", ""),
}
ORACLES |= {
    "corpus_build_content": ORACLES["clean_content"],
    "corpus_build_authors": ORACLES["paper_authors_explode"],
    "extra_papers_content": ORACLES["clean_content_no_dates"],
    "titles_and_abstracts": _with("papers", (
        "SELECT 'title' AS kind, title AS body FROM papers UNION ALL SELECT 'abstract', abstr FROM papers")),
    "first_publications_deduped": _with("dated_authors", "SELECT DISTINCT auid, year FROM dated_authors"),
    "hindex_snapshot_copied": _with("raw_authors", (
        "SELECT auid, n % 11 AS hindex FROM raw_numbers WHERE n % 2 = 0"), _RAW_HINDEX),
    "masked_abstracts_stored_once": _with("", "SELECT id, CAST(pos AS INTEGER) AS pos, term FROM masked_tokens", {
        "masked": (f"SELECT eid, lower({_masked('abstr')}) AS body FROM papers", "papers"),
        "masked_tokens": (_tokenized("masked", "eid", "body"), ""),
    }),
    "embedding_build_vectors": ORACLES["paper_embedding_weighted_mean"],
    "embedding_build_journals": _with("text_vectors papers", _long("journal_means", "id", W), {
        "journal_means": (_mean_vectors(
            "(SELECT p.issn AS id, v.embedding FROM text_vectors v JOIN papers p ON p.eid = v.id)", "id", W), ""),
    }),
    "embedding_build_areas": ORACLES["area_onehot"],
    "author_build_percentiles": _with("raw_authors", (
        f"SELECT DISTINCT issn, CAST(hindex AS DOUBLE) AS hindex, {r6('p', 'ptile')} FROM (SELECT a.issn, h.hindex, "
        "percent_rank() OVER (PARTITION BY a.issn ORDER BY h.hindex) AS p FROM (SELECT DISTINCT issn, auid FROM raw_authors) a "
        "JOIN raw_hindex h ON h.auid = a.auid)"), _RAW_HINDEX),
    "author_build_pairs": _with("raw_authors", (
        'SELECT DISTINCT a.auid AS "left", b.auid AS "right" FROM raw_clear a JOIN raw_clear b ON a.eid = b.eid AND a.auid <> b.auid'),
        _RAW_CLEAR),
    "author_build_pairs_with_papers": _with("raw_authors", (
        'SELECT a.eid, a.issn, a.auid AS "left", b.auid AS "right" FROM raw_clear a JOIN raw_clear b '
        "ON a.eid = b.eid AND a.auid <> b.auid"), _RAW_CLEAR),
}
