"""The queries of this subpackage, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from weftline.llm import contain, conversations, divergence, licences, neardup, packing, pagetext, quality, records, suffixes, vectors, warc


def queries() -> dict:
    return {
        "op1_length_buckets": packing.op1_length_buckets,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_ngram_jaccard_join": neardup.op3_ngram_jaccard_join,
        "op4_page_text": pagetext.op4_page_text,
        "op5_benchmark_leaks": contain.op5_benchmark_leaks,
        "op6_binary_records": records.op6_binary_records,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_license_scan": licences.op8_license_scan,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_warc_derivatives": warc.op10_warc_derivatives,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_embedding_neardup": vectors.op13_embedding_neardup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_length_buckets": packing.OP1_SQL, "op5_benchmark_leaks": contain.OP5_SQL, "op8_license_scan": licences.OP8_SQL, "op10_warc_derivatives": warc.OP10_SQL, "op11_conversation_repair": conversations.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_embedding_neardup": vectors.OP13_SQL}
