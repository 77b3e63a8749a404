"""The queries of this folder and their SQL."""

from . import chat_format, decontaminate, exact_dedup, lang_id, line_dedup, near_dedup, sampled_pieces, secret_scan, sharding, warc_audit

QUERIES = {
    "op1_extendible_sharding": sharding.op1_extendible_sharding,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_warc_audit": warc_audit.op7_warc_audit,
    "op8_language_id": lang_id.op8_language_id,
    "op9_sampled_pieces": sampled_pieces.op9_sampled_pieces,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
#: The others are tested against brute force, exact round trips and held-out accuracy.
ORACLE_SQL = {
    "op1_extendible_sharding": sharding.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_chat_format": chat_format.SQL,
    "op6_secret_scan": secret_scan.SQL,
    "op7_warc_audit": warc_audit.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
