"""The queries opN_<name> of the corpus operators, and SQL that gives the same rows where SQL can."""

from . import bpe, langid, licenses, mixing, ngram_join, pii, quality, secrets, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_quality": quality.op3_quality,
    "op4_bpe": bpe.op4_bpe,
    "op5_language": langid.op5_language,
    "op6_secrets": secrets.op6_secrets,
    "op7_licenses": licenses.op7_licenses,
    "op8_topk": topk.op8_topk,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
}

SQL = {"op2_ngram_join": ngram_join.OP2_SQL, "op3_quality": quality.OP3_SQL, "op6_secrets": secrets.OP6_SQL, "op7_licenses": licenses.OP7_SQL, "op8_topk": topk.OP8_SQL, "op10_pii": pii.OP10_SQL}
