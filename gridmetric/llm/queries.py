"""Queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

import corpus_pipeline
from gridmetric.llm import ann, audio, bpe, centroids, fim, langid, linededup, lm, minhash, packing, secrets, triebpe, urls


def queries():
    return {
        "op1_interpolated_lm": lm.op1_interpolated_lm,
        "op2_audio_features": audio.op2_audio_features,
        "op3_url_filter": urls.op3_url_filter,
        "op4_one_bit_neighbours": ann.op4_one_bit_neighbours,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_bottom_k_dedup": minhash.op6_bottom_k_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_language_id": langid.op8_language_id,
        "op9_line_dedup": linededup.op9_line_dedup,
        "op10_packing": packing.op10_packing,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_centroids": centroids.op12_centroids,
        "op13_trie_bpe": triebpe.op13_trie_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {"op9_line_dedup": linededup.OP9_SQL, "op11_fill_in_middle": fim.OP11_SQL, "op12_centroids": centroids.OP12_SQL}
