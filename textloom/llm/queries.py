"""The queries of this folder and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_extract, license_scan, merkle, mixing, ngram_join, quality, token_alignment, token_counts, token_output, url_filter, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_quality": quality.op3_quality,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_token_output": token_output.op8_token_output,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_warc": warc.op12_warc,
    "op13_token_alignment": token_alignment.op13_token_alignment,
    "mix_targets": mixing.mix_targets,
    "url_rules": url_filter.url_rules,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op5_ngram_join": ngram_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_warc": warc.SQL,
    "mix_targets": mixing.SQL_TARGETS,
    "url_rules": url_filter.SQL_RULES,
}
