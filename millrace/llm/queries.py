"""Registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import oracles
from millrace.llm.common import read_documents, read_table, shared_dir, staged
from millrace.llm.conversations import member_digests, ordered_turns, prefix_nodes, spliced, subtree_totals
from millrace.llm.decontaminate import contaminated_spans
from millrace.llm.filters import audit_edges, audit_orders, mark_later_copies, text_measures
from millrace.llm.licenses import scan_licenses
from millrace.llm.lines import drop_repeated_lines, lines_of
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.quality import apply_quality_rules
from millrace.llm.shards import assign_shards
from millrace.llm.simhash import simhash_components
from millrace.llm.substrings import remove_repeats
from millrace.llm.token_counts import count_tokens, write_token_files
from millrace.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdict of the quality rules for every document."""
    q = apply_quality_rules(read_documents(spark, sf_dir))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in columns])


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by jump consistent hashing of doc_id (law: key)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(rows, "doc_id", 40, ("text_crc32",))


_HELD_OUT = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out fifth."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_toxicity(read_documents(spark, sf_dir), labels, f"{_HELD_OUT} <> 0")
    return scored.select(
        "doc_id",
        F.coalesce(F.expr(f"{_HELD_OUT} = 0"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in sequences of 4096, one row for each piece."""
    pieces = pack_documents(read_documents(spark, sf_dir), vocabulary())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that lie in 50-byte strings of earlier documents, and a digest of the rest."""
    found = remove_repeats(read_documents(spark, sf_dir))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return found.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows, and the items they come from."""
    docs = read_documents(spark, sf_dir)
    spans = contaminated_spans(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return spans.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, its own or inherited.

    Documents stand for files at source/lang/doc_id; those of up to 40 words with
    a licence statement stand for licence files of their directory. Rows of one
    doc_id and place are one file; rows without a doc_id are told apart by their text.
    """
    docs = read_documents(spark, sf_dir, ("doc_id", "text", "lang", "source"))
    short = (F.size(F.split("text", r"\s+")) <= 40) & F.col("text").rlike("(?i)licen[sc]ed? |rights reserved")
    # documents without an id are files of their own, named by their text
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    name = F.when(short, F.concat(F.lit("LICENSE."), own)).otherwise(own)
    paths = docs.select("doc_id", F.concat_ws("/", "source", "lang", name).alias("path"), "text")
    found = scan_licenses(paths.select("path", "text"))
    owners = staged(paths.select("doc_id", "path").distinct(), "license-paths")
    return owners.join(found, "path").select("doc_id", "path", "license", "similarity", "inherited", "inherited_from")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least doc_id of its near-duplicate component."""
    found = simhash_components(read_documents(spark, sf_dir))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, read back from flat token files by its end ids."""
    folder = f"{shared_dir(spark)}/millrace/token-files-{uuid.uuid4().hex}"
    end = 49407
    files = write_token_files(read_documents(spark, sf_dir), folder, vocabulary(), end)
    counts = count_tokens(files.select("file", "bytes").distinct(), folder, end)
    return files.join(counts, ["file", "ordinal"], "left").select(F.col("id").alias("doc_id"), "n_tokens")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed as later copies, their runs, and a digest of what is left."""
    found = drop_repeated_lines(read_documents(spark, sf_dir))
    gone = F.col("removed_lines")
    runs = F.filter(gone, lambda x, i: (F.get(gone, i - 1) != x - 1) | (i == 0))
    worded = F.filter(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    return found.select(
        "doc_id",
        F.coalesce(F.size(worded), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"),
        F.size(runs).cast("long").alias("n_runs"),
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"),
    )


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, toxic), one row for each labelled document."""
    labels = read_table(spark, sf_dir, "labels").where("doc_id IS NOT NULL")
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over the documents of each language: what each removes at each step of all 120 orders."""
    m = text_measures(F.col("text"))
    docs = read_documents(spark, sf_dir, ("doc_id", "text", "lang")).select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        (m["n_words"] < 200).alias("A"),
        (100 * m["n_distinct"] < 50 * m["n_words"]).alias("B"),
        (100 * m["n_capitals"] > 3 * m["n_chars"]).alias("C"),
        m["has_symbol"].alias("D"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    docs = mark_later_copies(staged(docs, "filter-verdicts"), "doc_id", "digest", "E")
    labels = _labelled(spark, sf_dir)
    rows = docs.join(labels, "doc_id", "left").select(
        "part",
        *"ABCDE",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
    )
    edges = audit_edges(rows, "part", list("ABCDE"), ["good", "toxic"])
    steps = audit_orders(edges, "part", list("ABCDE"), ["good", "toxic"])
    return steps.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each rebuilt on the first turns of one in a hundred."""
    turns = ordered_turns(read_table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt, convs = spliced(turns, F.expr("conv_id - conv_id % 100"), head, 5)
    nodes, ends = prefix_nodes(rebuilt, convs)
    found = subtree_totals(nodes).join(member_digests(ends), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id",
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources by the weights 1, 2, 3 takes of every document; labelled quality scales the sampling."""
    text = F.coalesce("text", F.lit(""))
    docs = read_documents(spark, sf_dir, ("doc_id", "text", "source")).select(
        "doc_id",
        "source",
        text_measures(F.col("text"))["n_words"].alias("size"),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).alias("key"),
    )
    labelled = docs.join(_labelled(spark, sf_dir).drop("toxic"), "doc_id", "left")
    good = F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.25).otherwise(0.5)
    mixed = mix_sources(labelled.withColumn("quality", good), "key")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_license_scan": op7_license_scan,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_source_mix": op13_source_mix,
}

#: XXH64, CRC-32 and token ids are beyond SQL, and all 50-byte strings too slow; those queries are tested by brute force.
ORACLES: dict[str, str] = {
    "op1_quality_rules": oracles.QUALITY,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op10_line_dedup": oracles.LINE_DEDUP,
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_conversation_trie": oracles.CONVERSATION_TRIE,
    "op13_source_mix": oracles.SOURCE_MIX,
}
