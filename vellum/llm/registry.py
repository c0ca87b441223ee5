"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from vellum.llm import htmltext, linededup, mixing, onebit, packing, saat, sharding, simhash, toxicity, warc

QUERIES = {
    "op8_warc": warc.op8_warc,
    "op3_htmltext": htmltext.op3_htmltext,
    "op1_saat": saat.op1_saat,
    "op6_onebit": onebit.op6_onebit,
    "op2_sharding": sharding.op2_sharding,
    "op7_linededup": linededup.op7_linededup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op10_mixing": mixing.op10_mixing,
    "op5_packing": packing.op5_packing,
    "op9_simhash": simhash.op9_simhash,
}

ORACLES: dict[str, str] = {
    "op8_warc": warc.ORACLE,
    "op1_saat": saat.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
