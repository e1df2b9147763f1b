"""A corpus pipeline of five stages over ``documents``; each calls one operator of ``disclosight.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. Its result is written as Parquet and read again as
the ``docs`` of the next one. All but the last return the columns of ``docs``, whatever further columns there are.

1. language: documents that language identification rejects go.
2. near copies: of each group of linked documents the one with the smallest id stays.
3. passages: passages of 50 words or more that an earlier document holds too are cut out; a document without words left goes.
4. personal data: every span is replaced by its kind.
5. packing: the texts as pieces of sequences of 1024 ids.

A document is an id and a text. Rows without an id are known by their text; where rows of one id hold different texts, the
text with the least hash goes by the id and each other one by id and text. Both come after all others where the smallest
id counts. Of rows that repeat id and text one stays after stage 2. ``n_chars`` follows the text wherever a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from disclosight.llm import best_fit, jaccard_join, language_id, passages, personal_data
from disclosight.llm.common import SPACE, WORD, settle, slices, table, working_for

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free_name(docs: DataFrame, label: str) -> str:
    """A column name that ``docs`` does not use."""
    taken = {c.lower() for c in docs.columns}
    while label in taken:
        label += "_"
    return label


def _schema(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)


def _with_texts(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with new texts, and ``n_chars`` after them."""
    at = batch.schema.get_field_index("text")
    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
    at = batch.schema.get_field_index("n_chars")
    if at >= 0:
        batch = batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else len(t) for t in texts]).cast(batch.schema.field(at).type))
    return batch


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a number per document: its id, or one above all ids that its text (and its id) decides.

    Ids that hold different texts are found by one row per id, whatever the number of its rows. They are stored, so that the
    texts, which are read several times, are not shuffled each time to meet what mostly are few ids.
    """
    ident, mark, first = F.col("doc_id").cast("long"), F.xxhash64("text"), _free_name(docs, "first_text")
    held = _free_name(docs, "held_id")
    several = settle(docs.where(ident.isNotNull()).groupBy(ident.alias(held)).agg(F.min(mark).alias(first), F.max(mark).alias("last_text")).where(
        F.col(first) < F.col("last_text")).select(held, first), "several-texts")
    above = F.lit(1 << 62) + F.pmod(F.xxhash64(ident, "text"), F.lit(1 << 62))
    number = F.when(ident.isNull() | (F.col(first) < mark), above).otherwise(ident)
    return docs.join(several, ident == F.col(held), "left").withColumn(key, number).drop(held, first)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.train(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("languages")
        for part in slices(batches):
            yield part.filter(pa.array(language_id.accepted(model, part.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, _schema(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _free_name(docs, "document_key")
    keyed = _keyed(docs, key)
    groups = jaccard_join.join(keyed.select(F.col(key).alias("doc_id"), "text"))
    kept = groups.where("component_id = doc_id").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (first word, number of words)."""
    words = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for first, count in sorted(spans):
        begin, after = words[first][0], first + count
        end = words[after][0] if after < len(words) else len(text)
        if begin > done:
            out.append(text[done:begin])
        done = max(done, end)
    return ("".join(out) + text[done:]).rstrip(SPACE) if done == len(text) else "".join(out) + text[done:]


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, spans = _free_name(docs, "document_key"), _free_name(docs, "repeated_spans")
    keyed = _keyed(docs, key)
    found = passages.repeated_passages(keyed.select(F.col(key).alias("doc_id"), "text")).groupBy(F.col("doc_id").alias(key)).agg(
        F.collect_set(F.struct("start_word", "n_words")).alias(spans))
    marked = keyed.join(found, key, "left").select(*docs.columns, spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            plain = part.drop_columns([spans])
            texts, kept = part.column("text").to_pylist(), []
            for i, row in enumerate(part.column(spans).to_pylist()):
                if row:
                    texts[i] = cut_words(texts[i], [(r["start_word"], r["n_words"]) for r in row])
                kept.append(not row or WORD.search(texts[i]) is not None)
            yield _with_texts(plain, texts).filter(pa.array(kept, pa.bool_()))

    return marked.mapInArrow(cut, _schema(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = personal_data.learn(docs)

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("personal data")
        for part in slices(batches):
            yield _with_texts(part, [t if t is None else personal_data.mask(t, personal_data.all_spans(t, weights)) for t in part.column("text").to_pylist()])

    return docs.mapInArrow(hide, _schema(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
    ("mask_personal_data", mask_personal_data), ("packing", packing)]

#: The stages train models, chain seeds and pack online, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
