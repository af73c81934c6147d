"""The queries of this subpackage, one for each operator."""

from __future__ import annotations

from . import ann, bpe, license_scan, media_avi, mixing, ppm, simhash, suffix_dedup, toxicity, url_graph


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_media": media_avi.op2_media,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_simhash": simhash.op4_simhash,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_byte_bpe": bpe.op6_byte_bpe,
        "op7_url_graph": url_graph.op7_url_graph,
        "op8_nn_descent": ann.op8_nn_descent,
        "op9_mixing": mixing.op9_mixing,
        "op10_ppm": ppm.op10_ppm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": license_scan.ORACLE_SQL}
