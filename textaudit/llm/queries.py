"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from . import ann, bpe, chat_format, decontaminate, fill_in_middle, license_scan, linededup, merkle, neardup, quality, sharding, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_sharding": sharding.op4_sharding,
    "op5_neardup": neardup.op5_neardup,
    "op6_ann": ann.op6_ann,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_bpe": bpe.op9_bpe,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
ORACLE_SQL = {
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_license_scan": license_scan.OP7_SQL,
    "op8_chat_format": chat_format.OP8_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
