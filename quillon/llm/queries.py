"""The registered queries of this subpackage and the SQL that they are held against, where SQL can express them."""

from __future__ import annotations

from quillon.llm import decontaminate, embeddings, licenses, lm, packing, quality, secrets, simhash, token_files, warc

QUERIES = {
    "op1_simhash": simhash.simhash,
    "op2_embeddings": embeddings.embeddings,
    "op3_warc": warc.warc,
    "op4_licenses": licenses.licenses,
    "op5_secrets": secrets.secrets,
    "op6_quality": quality.quality,
    "op7_token_ids": token_files.token_ids,
    "op8_decontamination": decontaminate.decontamination,
    "op9_packing": packing.packed,
    "op10_lm_scores": lm.lm_scores,
}

ORACLE_SQL = {
    "op2_embeddings": embeddings.EMBEDDINGS_SQL,
    "op3_warc": warc.WARC_SQL,
    "op4_licenses": licenses.LICENSES_SQL,
    "op8_decontamination": decontaminate.DECONTAMINATION_SQL,
}
