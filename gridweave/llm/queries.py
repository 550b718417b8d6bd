"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, langid, line_dedup, lm, media, mixing, packing, quality, simhash, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_ann": ann.op4_ann,
    "op5_packing": packing.op5_packing,
    "op6_mixing": mixing.op6_mixing,
    "op7_media": media.op7_media,
    "op8_lm": lm.op8_lm,
    "op9_language": langid.op9_language,
    "op10_quality": quality.op10_quality,
}
ORACLES = {"op6_mixing": mixing.SQL}
