"""The subpackage's queries, over the whole tables and with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from . import classlm, cotraining, counts, licenses, merkle, mixing, pieces, rules, simhash, urls

QUERIES = {
    "op1_sentencepiece": pieces.op1_sentencepiece,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_token_counts": counts.op3_token_counts,
    "op4_url_filter": urls.op4_url_filter,
    "op5_merkle": merkle.op5_merkle,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_cotraining": cotraining.op8_cotraining,
    "op9_class_lm": classlm.op9_class_lm,
    "op10_licences": licenses.op10_licences,
}

ORACLES = {
    "op5_merkle": merkle.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
}
