"""Article records from XML documents: one row per article."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["pmid", "title", "abstract", "journal", "year", "mesh_terms", "authors", "firstauthoraffiliation"]
#: Shortest abstract of a record that is kept, and authors listed at most.
MIN_ABSTRACT, MAX_AUTHORS = 50, 10

_YEAR = re.compile(r"\d{4}")
_TYPE = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",error:string>>"


def _text(node, leading_only: bool) -> str:
    if node is None:
        return ""
    return (node.text or "") if leading_only else "".join(node.itertext())


def parse_article(article, leading_only: bool = False) -> dict[str, str] | None:
    """The fields of one article element, or None if its abstract is too short.

    With `leading_only`, text after the first inner markup is left out.
    """
    sections = []
    for part in article.iterfind(".//Abstract/AbstractText"):
        text = _text(part, leading_only)
        if text:
            label = part.get("Label")
            sections.append(f"{label}: {text}" if label else text)
    abstract = " ".join(sections)
    if len(abstract) < MIN_ABSTRACT:
        return None
    year = article.findtext(".//PubDate/Year") or ""
    if not year and (found := _YEAR.search(article.findtext(".//PubDate/MedlineDate") or "")):
        year = found[0]
    authors, affiliation = [], ""
    for i, author in enumerate(article.iterfind(".//AuthorList/Author")):
        if i == 0:
            affiliation = next((a.text.strip() for a in author.iterfind(".//Affiliation") if a.text and a.text.strip()), "")
        names = [x for x in (author.findtext("LastName"), author.findtext("ForeName")) if x]
        if author.findtext("LastName") is not None and names and len(authors) < MAX_AUTHORS:
            authors.append(", ".join(names))
    terms = [d.text for d in article.iterfind(".//MeshHeading/DescriptorName") if d.text]
    return {
        "pmid": article.findtext(".//PMID") or "",
        "title": _text(article.find(".//ArticleTitle"), leading_only),
        "abstract": abstract,
        "journal": article.findtext(".//Journal/Title") or article.findtext(".//Journal/ISOAbbreviation") or "",
        "year": year,
        "mesh_terms": "; ".join(terms),
        "authors": "; ".join(authors),
        "firstauthoraffiliation": affiliation,
    }


def parse_records(df: DataFrame, xml_col: str = "xml", keep: list[str] | None = None, leading_only: bool = False) -> DataFrame:
    """The articles of each XML document, with the kept columns and an `error` column.

    A document that is not well-formed gives one row of nulls with the parser's message; a
    null document gives none; articles with a short abstract are left out.
    """

    @F.arrow_udf(_TYPE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            offsets, rows = [0], []
            for document in batch.to_pylist():
                try:
                    root = ElementTree.fromstring(document) if document else None
                    for article in root.iter("PubmedArticle") if root is not None else ():
                        if record := parse_article(article, leading_only):
                            rows.append([*record.values(), None])
                except ElementTree.ParseError as error:
                    rows.append([None] * len(FIELDS) + [str(error)])
                offsets.append(len(rows))
            columns = list(zip(*rows)) or [()] * (len(FIELDS) + 1)
            flat = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], [*FIELDS, "error"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    parsed = df.select(*(keep or []), parse.asNondeterministic()(F.col(xml_col)).alias("_records"))
    return parsed.select(*(keep or []), F.inline("_records"))
