"""The queries of this subpackage and, where SQL can express them, their DuckDB texts."""

from __future__ import annotations

from . import ann, bpe, jaccard, lexical, minhash, mixing, pii, secret_scan, sharding, substring, topk, toxicity, variants

QUERIES = {
    "op1_anisotropic_ann": ann.op1_anisotropic_ann,
    "op2_pii_spans": pii.op2_pii_spans,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_exact_topk": topk.op8_exact_topk,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_flow_resharding": sharding.op10_flow_resharding,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_minhash_dedup": minhash.op12_minhash_dedup,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES = {
    "op2_pii_spans": pii.ORACLE,
    "op4_source_mixing": mixing.ORACLE,
    "op5_jaccard_join": jaccard.ORACLE,
    "op6_secret_scan": secret_scan.ORACLE,
    "op8_exact_topk": topk.ORACLE,
    "op11_spelling_variants": variants.ORACLE,
    "op12_minhash_dedup": minhash.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
