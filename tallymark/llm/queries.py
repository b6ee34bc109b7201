"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tallymark.llm import codes, cover, fingerprint, infill, minhash, mixing, packing, pii, quality, secretscan, suffix, tokens, toxicity

QUERIES = {
    "op1_near_duplicates": minhash.op1_near_duplicates,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_pack": packing.op4_pack,
    "op5_pii": pii.op5_pii,
    "op6_quality": quality.op6_quality,
    "op7_mix": mixing.op7_mix,
    "op8_token_files": tokens.op8_token_files,
    "op9_repeated_passages": suffix.op9_repeated_passages,
    "op10_secrets": secretscan.op10_secrets,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_earlier_passages": cover.op12_earlier_passages,
    "op13_fill_in_middle": infill.op13_fill_in_middle,
}

ORACLE_SQL = {"op6_quality": quality.OP6_SQL, "op7_mix": mixing.OP7_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_earlier_passages": cover.OP12_SQL, "op13_fill_in_middle": infill.OP13_SQL}
