"""Queries of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sutur.llm.mixing import ALL_TOKENS, mixture, mixture_shares
from sutur.llm.overlap import cross_split_pairs, cross_split_report
from sutur.llm.residue import judge_documents
from sutur.llm.splits import assign_splits, broken_groups, current_partitions, related_groups, requested_ratios, split_report
from sutur.llm.terms import marked_terms
from sutur.llm.tokens import encode_corpus
from sutur.session import materialize, table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "error_analysis"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return related_groups(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "document_entities"))


def _found_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are assigned by whole groups, where the present partitions break their group."""
    assigned = materialize(_assigned(spark, sf_dir, report=False), "assigned")
    return broken_groups(assigned, current_partitions(table(spark, sf_dir, "split_metadata")))


def _assigned(spark: SparkSession, sf_dir: str, report: bool) -> DataFrame:
    manifest, ratios = table(spark, sf_dir, "manifest"), requested_ratios(table(spark, sf_dir, "split_metadata"))
    assigned = assign_splits(_groups(spark, sf_dir), manifest, ratios)
    return split_report(assigned, manifest, ratios) if report else assigned


def queries() -> dict:
    return {
        "p2_found": _found_groups,
        "p2_groups": _groups,
        "p2_assign": lambda s, d: _assigned(s, d, report=False),
        "p2_report": lambda s, d: _assigned(s, d, report=True),
        "p3_found": lambda s, d: cross_split_pairs(table(s, d, "manifest"), table(s, d, "split_metadata")),
        "p3_report": lambda s, d: cross_split_report(table(s, d, "manifest"), table(s, d, "split_metadata")),
        "p5_found": lambda s, d: _terms(s, d).where("mark is not null").select("field", "term", "mark"),
        "p5_terms": lambda s, d: _terms(s, d),
        "p6_ids": lambda s, d: encode_corpus(table(s, d, "documents")),
        "p6_sizes": lambda s, d: encode_corpus(table(s, d, "documents"), only_counts=True),
        "p7_mixture": lambda s, d: mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
        "p7_shares": lambda s, d: mixture_shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_mixture_of_all": lambda s, d: mixture(table(s, d, "documents"), table(s, d, "mix_targets"), ALL_TOKENS)[0],
        "p7_shares_of_all": lambda s, d: mixture_shares(table(s, d, "documents"), table(s, d, "mix_targets"), ALL_TOKENS),
        "p8_found": lambda s, d: _judged(s, d).where("excluded").select("doc_id"),
        "p8_kinds": lambda s, d: _judged(s, d).where(F.size("kinds") > 0),
        "p8_clean": lambda s, d: _judged(s, d).where("not excluded").select("doc_id"),
    }
