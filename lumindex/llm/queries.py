"""Registered training-data queries: opN_<name> applies operator N to its whole table."""

import corpus_pipeline

from . import bpe, embedding_dedup, hnsw, langid, line_dedup, minhash, packing, suffix_dedup, token_count, warc

QUERIES = {
    "op1_langid": langid.op1,
    "op2_minhash": minhash.op2,
    "op3_embedding_dedup": embedding_dedup.op3,
    "op4_token_count": token_count.op4,
    "op5_hnsw": hnsw.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_bpe": bpe.op7,
    "op8_suffix_dedup": suffix_dedup.op8,
    "op9_packing": packing.op9,
    "op10_warc": warc.op10,
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLES: dict[str, str] = {"op10_warc": warc.OP10_SQL}
