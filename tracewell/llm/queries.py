"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import op1_html, op2_suffix, op3_decontaminate, op4_embeddings, op5_minhash, op6_langid, op7_urls, op8_tokens, op9_shards, op10_bpe, op11_variants, op12_divergence, op13_warc

QUERIES = {"op1_html": op1_html.op1_html, "op2_suffix_dedup": op2_suffix.op2_suffix_dedup, "op3_decontaminate": op3_decontaminate.op3_decontaminate, "op4_embeddings": op4_embeddings.op4_embeddings, "op5_minhash": op5_minhash.op5_minhash, "op6_langid": op6_langid.op6_langid, "op7_url_filters": op7_urls.op7_url_filters, "op8_token_counts": op8_tokens.op8_token_counts, "op9_training_order": op9_shards.op9_training_order, "op10_bpe": op10_bpe.op10_bpe, "op11_variants": op11_variants.op11_variants, "op12_divergence": op12_divergence.op12_divergence, "op13_warc": op13_warc.op13_warc}
SQL = {"op3_decontaminate": op3_decontaminate.OP3_SQL, "op4_embeddings": op4_embeddings.OP4_SQL, "op5_minhash": op5_minhash.OP5_SQL, "op7_url_filters": op7_urls.OP7_SQL, "op8_token_counts": op8_tokens.OP8_SQL, "op11_variants": op11_variants.OP11_SQL, "op12_divergence": op12_divergence.OP12_SQL, "op13_warc": op13_warc.OP13_SQL}
