"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, html_extract, importance, license_scan, ngram_join, packing, quality, substring_dedup, token_counts, turn_repair, url_filter, warc

QUERIES = {
    "op1_token_counts": token_counts.op1,
    "op2_warc": warc.op2,
    "op3_decontaminate": decontaminate.op3,
    "op4_quality": quality.op4,
    "op5_packing": packing.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_html_extract": html_extract.op7,
    "op8_url_filter": url_filter.op8,
    "op9_chat": chat.op9,
    "op10_ngram_join": ngram_join.op10,
    "op11_license_scan": license_scan.op11,
    "op12_importance": importance.op12,
    "op13_turn_repair": turn_repair.op13,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_chat": chat.OP9_SQL,
    "op10_ngram_join": ngram_join.OP10_SQL,
    "op11_license_scan": license_scan.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_turn_repair": turn_repair.OP13_SQL,
}
