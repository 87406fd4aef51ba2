"""Queries of the corpus operators and the SQL that says the same, where SQL can."""

from . import op1_minhash, op2_topk, op3_pii, op4_packing, op5_bpe, op6_lines, op7_language, op8_secrets, op9_ngram, op10_tiff

QUERIES, ORACLE = {}, {}
for _module in (op1_minhash, op2_topk, op3_pii, op4_packing, op5_bpe, op6_lines, op7_language, op8_secrets, op9_ngram, op10_tiff):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
