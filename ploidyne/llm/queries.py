"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ploidyne.llm import decontam, langid, lm, media, minhash, mixing, quality, sharding, urlfilter, warc


def queries() -> dict:
    return {
        "op1_url_filter": urlfilter.op1,
        "op2_sharding": sharding.op2,
        "op3_minhash": minhash.op3,
        "op4_media": media.op4,
        "op5_quality": quality.op5,
        "op6_langid": langid.op6,
        "op7_warc": warc.op7,
        "op8_decontamination": decontam.op8,
        "op9_lm_score": lm.op9,
        "op10_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": urlfilter.ORACLE, "op7_warc": warc.ORACLE, "op10_mixing": mixing.ORACLE}
