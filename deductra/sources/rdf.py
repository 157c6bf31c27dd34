"""Triples as DataFrames: N-Triples at scale, other formats through the driver, tables by direct mapping."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as T
from ..operators.storage import small_table
from . import n3, rdfxml

def facts_df(spark: SparkSession, facts) -> DataFrame:
    """Driver-side facts as a DataFrame."""
    return small_table(spark, facts, dict.fromkeys("spo", "string"))


_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*\.\s*(?:#.*)?$"


def unread_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither triples, comments nor blank."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Distributed N-Triples scan; comments and blank lines are skipped, implications dropped, duplicates removed.

    ``strict``: a line that can't be read fails the query when it is scanned; otherwise such
    lines are left out, and ``unread_ntriples`` gives them.
    """
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    fits = F.col("value").rlike(_LINE)
    if strict:
        text = text.withColumn("value", F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an N-Triples line: "), F.substring("value", 1, 200)))))
    else:
        text = text.where(fits)
    out = text.select(*[F.regexp_extract("value", _LINE, i + 1).alias(c) for i, c in enumerate("spo")])
    return out.where(F.col("p") != n3.IMPLIES).distinct()


def read_document(path: str, fmt: str | None = None, registry=None) -> n3.Document:
    """A local file: n3, turtle, nt or xml."""
    text = Path(path).read_text(encoding="utf-8")
    fmt = fmt or {".rdf": "xml", ".xml": "xml", ".owl": "xml"}.get(Path(path).suffix, "n3")
    if fmt == "xml":
        return n3.Document(facts=rdfxml.parse(text))
    if fmt not in ("n3", "turtle", "nt"):
        raise ValueError(f"format {fmt} isn't supported")
    return n3.parse(text, registry)


def with_imports(doc: n3.Document, locate, fmt: str | None = None) -> n3.Document:
    """The document with every ontology it imports, each read once; ``locate`` gives the local path of an IRI."""
    seen, have, todo = set(), set(doc.facts), list(doc.facts)
    while todo:
        s, p, o = todo.pop()
        if p == T.owl("imports") and o not in seen:
            seen.add(o)
            more = read_document(locate(o[1:-1]), fmt)
            new = [f for f in dict.fromkeys(more.facts) if f not in have]
            have.update(new)
            doc.facts += new
            todo += new
            doc.rules += more.rules
    return doc


def write_ntriples(triples: DataFrame, path: str) -> None:
    """One line a triple, in parallel."""
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("value")).write.text(path)


def map_table(df: DataFrame, key: str, base: str, columns: list[str] | None = None) -> DataFrame:
    """Direct mapping: ``<base/key>`` with ``<base#column>`` and the value as a typed literal; nulls give no triple."""
    kinds = dict(df.dtypes)
    subject = F.concat(F.lit(f"<{base}/"), F.col(key).cast("string"), F.lit(">"))

    def obj(c):
        text = F.col(c).cast("string")
        kind = kinds[c]
        if kind in ("int", "bigint", "smallint", "tinyint"):
            return F.concat(F.lit('"'), text, F.lit(f'"^^<{T.XSD}integer>'))
        if kind in ("double", "float"):
            return F.concat(F.lit('"'), text, F.lit(f'"^^<{T.XSD}double>'))
        safe = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
        return F.concat(F.lit('"'), safe, F.lit('"'))

    pairs = F.array(*[F.struct(F.lit(f"<{base}#{c}>").alias("p"), obj(c).alias("o")) for c in columns or [c for c in df.columns if c != key]])
    return df.select(subject.alias("s"), F.explode(pairs).alias("po")).where("po.o is not null").select("s", "po.p", "po.o")
