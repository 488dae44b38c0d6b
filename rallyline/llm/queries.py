"""Registration of the operators' queries and of their SQL."""

from __future__ import annotations

from rallyline.llm import html, itq, jaccard, langid, licenses, mixing, packing, scoring, suffix, topk

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_topk": topk.op2_topk,
    "op3_langid": langid.op3_langid,
    "op4_itq": itq.op4_itq,
    "op5_lm_scoring": scoring.op5_lm_scoring,
    "op6_suffix_dedup": suffix.op6_suffix_dedup,
    "op7_html": html.op7_html,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
}
SQL = {"op2_topk": topk.SQL, "op5_lm_scoring": scoring.SQL, "op8_license_scan": licenses.SQL, "op9_mixing": mixing.SQL}
