"""The queries of this subpackage, and the SQL for those that DuckDB can express."""

from __future__ import annotations

from . import ann, bpe, chat, decontaminate, lm, mixing, pii, pq, quality, sharding, simhash, warc, whiten


def queries() -> dict:
    return {
        "op1_ann_search": ann.op1_ann_search,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_warc": warc.op3_warc,
        "op4_pii": pii.op4_pii,
        "op5_quality": quality.op5_quality,
        "op6_sharding": sharding.op6_sharding,
        "op7_mixing": mixing.op7_mixing,
        "op8_simhash_dedup": simhash.op8_simhash_dedup,
        "op9_chat_format": chat.op9_chat_format,
        "op10_lm_score": lm.op10_lm_score,
        "op11_whitening": whiten.op11_whitening,
        "op12_bpe": bpe.op12_bpe,
        "op13_vector_codes": pq.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": decontaminate.OP2_SQL,
        "op3_warc": warc.OP3_SQL,
        "op9_chat_format": chat.OP9_SQL,
    }
