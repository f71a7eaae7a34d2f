"""The registered queries of this subpackage and their DuckDB SQL."""

from . import decontamination, embedding_dedup, line_dedup, mixing, ngram_join, quality, sale_enrichment, sharding, token_counts, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_sharding": sharding.op4_sharding,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_quality": quality.op7_quality,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_sale_enrichment": sale_enrichment.op13_sale_enrichment,
}

SQL = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op3_ngram_join": ngram_join.SQL,
    "op4_sharding": sharding.SQL,
    "op6_url_filter": url_filter.SQL,
    "op8_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op13_sale_enrichment": sale_enrichment.SQL,
}
