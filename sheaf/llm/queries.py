"""Queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import codedocs, leaks, names, pages, papers, runs, sections, tokens, truncation, turns
from sheaf.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sections.found(table(spark, d, "documents"), table(spark, d, "sections"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every section longer than a page slice."""
    return sections.split_sections(table(spark, d, "documents"), table(spark, d, "sections"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each section."""
    return sections.piece_checks(table(spark, d, "documents"), table(spark, d, "sections"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return papers.found(table(spark, d, "citation_records"))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return papers.merged_papers(table(spark, d, "citation_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.found(table(spark, d, "captions"))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every cue with words, runs collapsed into one with count and whole duration."""
    return runs.cue_runs(table(spark, d, "captions").where("video_id IS NOT NULL"), ["video_id"], "seg_idx")


def p3_window_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two or more among the segments of windows."""
    return runs.window_runs(table(spark, d, "windows"), least=2)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.found(table(spark, d, "citation_records"))


def p4_authors(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling with its author: membership in place of pairs."""
    return names.linked_names(table(spark, d, "citation_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return codedocs.found(table(spark, d, "source_files"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return codedocs.documented_functions(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.found(table(spark, d, "fetch_responses"))


def p6_bodies(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_bodies(table(spark, d, "fetch_responses"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.found(table(spark, d, "captions"), table(spark, d, "chapters"))


def p7_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.speaker_turns(table(spark, d, "captions"), table(spark, d, "chapters"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p2_found, p2_records, p3_found, p3_runs, p3_window_runs, p4_found, p4_authors, p5_found, p5_pairs, p6_found, p6_bodies, p7_found, p7_turns, p8_ids, p9_found, p10_found, p10_rates)}
