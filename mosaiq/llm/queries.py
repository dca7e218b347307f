"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credentials, minhash, mixing, ogg, oracles, packing, quality_model, quality_rules, run_index, substring_index, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_index": substring_index.op1,
        "op2_url_aliases": url_filter.op2,
        "op3_weak_supervision": quality_rules.op3,
        "op4_run_length_index": run_index.op4,
        "op5_minhash_dedup": minhash.op5,
        "op6_ogg_media": ogg.op6,
        "op7_best_fit_packing": packing.op7,
        "op8_credential_linking": credentials.op8,
        "op9_fourier_quality": quality_model.op9,
        "op10_curriculum_mix": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    """The others fit models, pack, mix by a hash order, or make binary forms: they are tested against brute force."""
    return {"op1_substring_index": oracles.OP1, "op2_url_aliases": oracles.OP2, "op4_run_length_index": oracles.OP4, "op5_minhash_dedup": oracles.OP5}
