"""The queries of this subpackage and their SQL, by name."""

from keysift.llm import chat, decontaminate, line_dedup, lm_score, packing, quality, repeats, simhash, url_filter, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_warc": warc.op2_warc,
    "op3_suffix_dedup": repeats.op3_suffix_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_simhash": simhash.op5_simhash,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_packing": packing.op9_packing,
    "op10_url_filters": url_filter.op10_url_filters,
}
SQL = {"op2_warc": warc.OP2_SQL, "op6_quality_rules": quality.OP6_SQL, "op8_chat_format": chat.OP8_SQL, "op10_url_filters": url_filter.OP10_SQL}
