"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from __future__ import annotations

from . import ann, clusters, fim, langid, linededup, lm, mixing, neardup, packing, pii, secrets, simhash, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_neardup": neardup.op3_neardup,
    "op4_lm": lm.op4_lm,
    "op5_secrets": secrets.op5_secrets,
    "op6_pii": pii.op6_pii,
    "op7_langid": langid.op7_langid,
    "op8_simhash": simhash.op8_simhash,
    "op9_ann": ann.op9_ann,
    "op10_packing": packing.op10_packing,
    "op11_fim": fim.op11_fim,
    "op12_clusters": clusters.op12_clusters,
    "op13_linededup": linededup.op13_linededup,
}
#: The others have no SQL (models, automata, hashes, packing); tests hold them against brute force.
ORACLES = {"op1_mixing": mixing.ORACLE, "op4_lm": lm.ORACLE, "op11_fim": fim.ORACLE, "op12_clusters": clusters.ORACLE, "op13_linededup": linededup.ORACLE}
