"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import bpe, embeddings, language, licenses, packing, quality, secrets, simhash, token_counts, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_secrets": secrets.op5_secrets,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_quality": quality.op7_quality,
    "op8_language": language.op8_language,
    "op9_licenses": licenses.op9_licenses,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL: dict[str, str] = {"op4_warc": warc.OP4_SQL, "op6_embeddings": embeddings.OP6_SQL, "op7_quality": quality.OP7_SQL}
