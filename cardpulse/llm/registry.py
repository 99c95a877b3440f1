"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import corpus_pipeline
from cardpulse.llm import decontaminate, langid, lattice, linedup, mixing, packing, phrases, pii, resample, simhash, suffix, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_suffix": suffix.op3_suffix,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_mixing": mixing.op5_mixing,
        "op6_langid": langid.op6_langid,
        "op7_line_dedup": linedup.op7_line_dedup,
        "op8_warc": warc.op8_warc,
        "op9_pii": pii.op9_pii,
        "op10_lattice": lattice.op10_lattice,
        "op11_phrases": phrases.op11_phrases,
        "op12_packing": packing.op12_packing,
        "op13_resample": resample.op13_resample,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix": suffix.OP3_SQL,
        "op7_line_dedup": linedup.OP7_SQL,
        "op8_warc": warc.OP8_SQL,
        "op10_lattice": lattice.OP10_SQL,
        "op11_phrases": phrases.OP11_SQL,
        "op13_resample": resample.OP13_SQL,
    }
