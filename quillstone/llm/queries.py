"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quillstone.llm import ann, arrowseq, bpe, chat, jaccard, lm, mixing, negatives, packing, quality, suffix, toxicity, trie


def queries() -> dict:
    return {
        "op1_bpe_codec": bpe.op1,
        "op2_ivf_pq_neighbours": ann.op2,
        "op3_chat_format": chat.op3,
        "op4_ngram_jaccard_join": jaccard.op4,
        "op5_quality_rules": quality.op5,
        "op6_suffix_dedup": suffix.op6,
        "op7_arrow_sequences": arrowseq.op7,
        "op8_best_fit_packing": packing.op8,
        "op9_context_tree_lm": lm.op9,
        "op10_toxicity": toxicity.op10,
        "op11_prefix_trie": trie.op11,
        "op12_source_mixing": mixing.op12,
        "op13_hard_negatives": negatives.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_format": chat.OP3_SQL, "op4_ngram_jaccard_join": jaccard.OP4_SQL, "op5_quality_rules": quality.OP5_SQL, "op11_prefix_trie": trie.OP11_SQL, "op12_source_mixing": mixing.OP12_SQL, "op13_hard_negatives": negatives.OP13_SQL}
