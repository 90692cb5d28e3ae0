"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import ann, bpe, licenses, line_dedup, mixing, ngram_join, quality, sharding, topk, warc

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_sharding": sharding.op3_sharding,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_nearest": ann.op6_nearest,
    "op7_warc_fixity": warc.op7_warc_fixity,
    "op8_quality": quality.op8_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_bpe": bpe.op10_bpe,
}
ORACLE_SQL = {
    "op2_license_scan": licenses.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op7_warc_fixity": warc.OP7_SQL,
    "op5_exact_top_k": topk.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
