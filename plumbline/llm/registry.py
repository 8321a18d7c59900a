"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm import bpe, chat, html, langid, licenses, minhash, mixing, negatives, packing, toxicity, vacodes, vectors, webp

QUERIES = {
    "op1_mixture_language": langid.op1_mixture_language,
    "op2_hamming_join": minhash.op2_hamming_join,
    "op3_license_digests": licenses.op3_license_digests,
    "op4_segment_toxicity": toxicity.op4_segment_toxicity,
    "op5_pareto_mix": mixing.op5_pareto_mix,
    "op6_block_rules": html.op6_block_rules,
    "op7_streaming_bpe": bpe.op7_streaming_bpe,
    "op8_lossless_webp": webp.op8_lossless_webp,
    "op9_projection_forest": vectors.op9_projection_forest,
    "op10_preference_pairs": chat.op10_preference_pairs,
    "op11_harmonic_packing": packing.op11_harmonic_packing,
    "op12_va_codes": vacodes.op12_va_codes,
    "op13_bit_sliced_negatives": negatives.op13_bit_sliced_negatives,
}
ORACLES = {
    "op3_license_digests": licenses.ORACLE,
    "op5_pareto_mix": mixing.ORACLE,
    "op10_preference_pairs": chat.ORACLE,
    "op12_va_codes": vacodes.ORACLE,
    "op13_bit_sliced_negatives": negatives.ORACLE,
}
