"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all
but the last return the columns of ``docs``. ``run`` writes each result to the
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import read_table, staged
from millrace.llm.decontaminate import contaminated_spans
from millrace.llm.jaccard import drop_near_copies
from millrace.llm.lines import drop_repeated_lines
from millrace.llm.packing import pack_documents
from millrace.llm.quality import apply_quality_rules
from millrace.llm.queries import vocabulary


def _added(found: DataFrame, docs: DataFrame) -> list[str]:
    """The columns that an operator added, quoted: their names depend on those of ``docs``."""
    return [f"`{c}`" for c in found.columns[len(docs.columns) :]]


def _with_text(rows: DataFrame, text: str, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with another text, and its length in n_chars."""
    new = {"text": F.col(text), "n_chars": F.char_length(F.col(text)).cast("long")}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: failing lines go, and rejected documents go.

    Rows are judged one by one, so repeated rows and null ids stay or go alike; a
    null or empty text is rejected; an empty table gives an empty one. Other
    columns pass, whatever their names.
    """
    judged = apply_quality_rules(docs)
    (verdict,) = _added(judged, docs)
    return _with_text(judged.where(F.col(f"{verdict}.kept")), f"{verdict}.clean_text", docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: later copies of runs of lines go; a document that consisted of them alone goes too.

    The first copy is that of the least doc_id, null ones last; rows of one id and
    text are one document and keep the same lines. A null text stays null and its
    row stays; an empty table gives an empty one.
    """
    found = drop_repeated_lines(docs)
    clean, removed = _added(found, docs)
    left = found.where((F.size(removed) == 0) | F.col(clean).rlike(r"[^ \t\n\x0B\f\r]"))
    return _with_text(left, clean, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near copies one row stays, that of the least doc_id.

    SimHashes of five-word shingles are joined by the trie; links count if the sets'
    Jaccard similarity is 0.8 or more, and an exact prefix join adds the links that
    SimHashes miss, so none is missed. Rows of other groups stay whatever their
    doc_id, null or repeated; identical rows and texts without words are one group
    each; an empty table gives an empty one.
    """
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark window go.

    A null or empty text holds none; an empty benchmark removes nothing; repeated
    rows stay or go alike.
    """
    found = contaminated_spans(docs, read_table(spark, sf_dir, "benchmark"))
    _, spans, _ = _added(found, docs)
    return found.where(F.size(spans) == 0).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids in sequences of 4096, one row for each piece of a document.

    A null text is its end id alone; every row is packed, repeated ones too; an
    empty table gives an empty one; other columns are left out.
    """
    return pack_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: XXH64 fingerprints and token ids are beyond SQL; tests compare with a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
