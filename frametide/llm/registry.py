"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from frametide.llm import decontaminate, html_text, license_scan, line_dedup, packing, quality, sharding, simhash, url_rules, warc

QUERIES = {
    "op1_line_spread": line_dedup.query,
    "op2_url_rules": url_rules.query,
    "op3_binary_packing": packing.query,
    "op4_simhash_golay": simhash.query,
    "op5_license_windows": license_scan.query,
    "op6_host_quality": quality.query,
    "op7_histogram_shards": sharding.query,
    "op8_decontaminate": decontaminate.query,
    "op9_warc_chunks": warc.query,
    "op10_line_blocks": html_text.query,
}
ORACLE_SQL = {
    "op1_line_spread": line_dedup.ORACLE,
    "op2_url_rules": url_rules.ORACLE,
    "op5_license_windows": license_scan.ORACLE,
    "op6_host_quality": quality.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_warc_chunks": warc.ORACLE,
}
