"""The registered queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

from . import exact_dedup, html_extract, mixing, nbsvm, packing, quality_rules, secrets, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_block_labeller": html_extract.op1_block_labeller,
        "op2_secret_linking": secrets.op2_secret_linking,
        "op3_nbsvm_quality": nbsvm.op3_nbsvm_quality,
        "op4_chunked_warc": warc.op4_chunked_warc,
        "op5_simhash": simhash.op5_simhash,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_counterfactual_toxicity": toxicity.op7_counterfactual_toxicity,
        "op8_linear_grouping": packing.op8_linear_grouping,
        "op9_pareto_mixing": mixing.op9_pareto_mixing,
        "op10_llr_quality": quality_rules.op10_llr_quality,
        "quality_base_rules": quality_rules.quality_base_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_linking": secrets.SQL_OP2,
        "op4_chunked_warc": warc.SQL_OP4,
        "op6_exact_dedup": exact_dedup.SQL_OP6,
        "op9_pareto_mixing": mixing.SQL_OP9,
        "quality_base_rules": quality_rules.SQL_BASE,
    }
