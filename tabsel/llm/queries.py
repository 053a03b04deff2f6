"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, eliasfano, fertility, order_minhash, packing, quotation, separator_scan, superkmer, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.query,
    "op2_tokeniser_fertility": fertility.query,
    "op3_quotation_linking": quotation.query,
    "quotation_linking_quoted": quotation.quoted_query,
    "quotation_levels_quoted": quotation.links_query,
    "op4_multiprobe": ann.query,
    "op5_toxicity": toxicity.query,
    "op6_bpe": bpe.query,
    "op7_order_minhash": order_minhash.query,
    "op8_separator_scan": separator_scan.query,
    "op9_elias_fano": eliasfano.query,
    "op10_super_kmers": superkmer.query,
}

ORACLE_SQL: dict[str, str] = {"op3_quotation_linking": quotation.ORACLE_SQL, "quotation_linking_quoted": quotation.QUOTED_SQL, "quotation_levels_quoted": quotation.LINKS_SQL}
