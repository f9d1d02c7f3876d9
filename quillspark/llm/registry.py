"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import ann, bpe, mixing, neardup, pii, quality, secrets, substrings, toxicity, warc

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_minhash_neardup": neardup.op2_minhash_neardup,
    "op3_mixing": mixing.op3_mixing,
    "op4_ann": ann.op4_ann,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc,
    "op10_pii": pii.op10_pii,
    "quality_ablations": quality.quality_ablations,
}
ORACLES = {
    "op6_quality_rules": quality.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "quality_ablations": quality.ABLATION_SQL,
}
