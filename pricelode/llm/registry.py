"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelode.llm import cotrain, idfiles, langid, linededup, mixing, multiset, negatives, packing, rules, simhash, suffix, veccodes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_suffix_dedup": suffix.op2_suffix_dedup,
        "op3_language_id": langid.op3_language_id,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality_classifier": cotrain.op5_quality_classifier,
        "op6_fingerprints": multiset.op6_fingerprints,
        "op7_quality_rules": rules.op7_quality_rules,
        "op8_warc": warc.op8_warc,
        "op9_packing": packing.op9_packing,
        "op10_token_ids": idfiles.op10_token_ids,
        "op11_vector_codes": veccodes.op11_vector_codes,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_line_dedup": linededup.op13_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.op1_sql(),
        "op2_suffix_dedup": suffix.op2_sql(),
        "op8_warc": warc.op8_sql(),
        "op11_vector_codes": veccodes.op11_sql(),
        "op12_hard_negatives": negatives.op12_sql(),
        "op13_line_dedup": linededup.op13_sql(),
    }
