"""The queries of this subpackage and their DuckDB SQL."""

from . import decontam, dedup, embeddings, lines, mixing, pii, quality, tokenfile, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        dedup.op1_order_minhash,
        tokenfile.op2_elias_fano_tokens,
        pii.op3_skip_chain_pii,
        decontam.op4_cgk_decontamination,
        lines.op5_line_windows,
        warc.op6_warc_bundles,
        toxicity.op7_ftrl_toxicity,
        quality.op8_latent_neighbours,
        mixing.op9_pareto_mixing,
        embeddings.op10_cross_polytope,
    )
}

#: SQL can't express the others; the tests hold them against brute force, round trips and held-out labels.
ORACLES = {"op5_line_windows": lines.SQL, "op6_warc_bundles": warc.SQL, "op9_pareto_mixing": mixing.SQL}
