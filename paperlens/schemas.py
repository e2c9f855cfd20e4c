"""Record types of the corpus as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, F32, B, H = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
    T.FloatType(), T.BooleanType(), T.ShortType(),
)
STRINGS = T.ArrayType(S)
VECTOR = T.ArrayType(D)


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Field names below are fixed values: stored corpora use them.
AUTHOR = _record(
    authorSeq=I, auid=S, author_type=S, collaboration=S, degrees=S, e_address_type=S,
    given_name=S, given_name_pn=S, indexed_name=S, initials=S, initials_pn=S,
    nametext=S, orcid=S, suffix=S, surname=S, surname_pn=S,
)
AFFILIATION = _record(
    affiliation_address_part=S, affiliation_city=S, affiliation_city_group=S,
    affiliation_country=S, affiliation_ids=STRINGS, affiliation_organization=STRINGS,
    affiliation_organization_count=I, affiliation_postal_code=S, affiliation_state=S,
    affiliation_tag_country=S, affiliation_text=S, afid=S, dptid=S,
)
AUTHOR_AFFILIATION = _record(Authorseq=I, affiliation_seq=I, validity_B=B)
PAPER_TERM = _record(candidate=S, controlled=S, mainterm=S, type=S, weight=S)
PAPER_SOURCE = _record(
    article_number=S, country=S, date_day=S, date_month=S, date_text=S, date_year=S,
    e_address=S, e_address_type=S, isbn_electronic=STRINGS, isbn_other=STRINGS,
    isbn_print=STRINGS, issn_electronic=STRINGS, issn_other=STRINGS, issn_print=STRINGS,
    publishername=S, sourcetitle=S, sourcetitle_abbrev=S, srcid=S, type=S, website=S,
)
RAW_PAPER = _record(
    datesort=S, eid=S, doi=S, issn=S, title=S, abstr=S,
    au=T.ArrayType(AUTHOR), af=T.ArrayType(AFFILIATION),
    au_af=T.ArrayType(AUTHOR_AFFILIATION), citations=STRINGS, keywords=STRINGS,
    terms=T.ArrayType(PAPER_TERM), asjc=STRINGS, subjareas=STRINGS,
    source=PAPER_SOURCE, copyright_types=S,
)
CLEAN_PAPER = _record(
    eid=S, issn=S, title=S, abstr=S, subjareas=STRINGS, publishername=S,
    sourcetitle=S, sourcetitle_abbrev=S, year=H, month=H,
)
PAPER_AUTHORS = _record(eid=S, issn=S, au=T.ArrayType(AUTHOR))
PAPER_AUTHOR = _record(eid=S, issn=S, auid=S)
DATED_PAPER_AUTHORS = _record(
    eid=S, issn=S, subjareas=STRINGS, year=H, month=H, au=T.ArrayType(AUTHOR)
)
DATED_PAPER_AUTHOR = _record(eid=S, issn=S, subjareas=STRINGS, year=H, month=H, auid=S)
HINDEX = _record(auid=S, hindex=L)
FIRST_PUBLICATION = _record(auid=S, first_published=S)
REFERENCE = _record(datesort=S, issn=S, eid=S, reference=S)
TOKENIZED = _record(id=S, terms=STRINGS)
WEIGHTED_TERMS = _record(id=S, weights=T.MapType(S, D))
WORD_VECTOR = _record(word=S, embedding=T.ArrayType(F32))
VECTOR_ROW = _record(id=S, embedding=VECTOR)
YEAR_VECTOR_ROW = _record(id=S, embedding=VECTOR, year=H)
VECTOR_WITH_JOURNAL = _record(id=S, embedding=VECTOR, issn=S, subjareas=STRINGS)
ONE_HOT_ROW = _record(id=S, ohe=T.ArrayType(I), features=VECTOR)
CLASSIFIER_PERFORMANCE = _record(label=S, fitcount=L, totalcount=L, accuracy=D)
CLASSIFIER_EVALUATION = _record(
    cases=L, positives=L, predicted_positives=L, true_positives=L, true_negatives=L
)
PERCENTILE_ELEMENT = _record(value=D, ptile=D)
