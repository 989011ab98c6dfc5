"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import op1_toxicity, op2_warc, op3_simhash, op4_packing, op5_chat, op6_langid, op7_mixing, op8_search, op9_ctph, op10_tokens, op11_runs, op12_reversed, op13_quality


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": _pipeline,
    "op1_toxicity": op1_toxicity.query,
    "op2_warc": op2_warc.query,
    "op3_simhash": op3_simhash.query,
    "op4_packing": op4_packing.query,
    "op5_chat": op5_chat.query,
    "op6_langid": op6_langid.query,
    "op7_mixing": op7_mixing.query,
    "op8_search": op8_search.query,
    "op9_ctph": op9_ctph.query,
    "op10_tokens": op10_tokens.query,
    "op11_runs": op11_runs.query,
    "op12_reversed": op12_reversed.query,
    "op13_quality": op13_quality.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": op2_warc.SQL,
    "op5_chat": op5_chat.SQL,
    "op8_search": op8_search.SQL,
    "op11_runs": op11_runs.SQL,
    "op12_reversed": op12_reversed.SQL,
}
