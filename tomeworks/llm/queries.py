"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from tomeworks.llm import p1_distinctive, p3_lookalikes, p4_language, p5_survivor, p7_names, p8_contamination, p9_mixture, p10_repetition, sql

QUERIES = {
    "p1_found": p1_distinctive.p1_found,
    "p1_scores": p1_distinctive.p1_scores,
    "p3_found": p3_lookalikes.p3_found,
    "p3_plain": p3_lookalikes.p3_plain,
    "p4_found": p4_language.p4_found,
    "p4_documents": p4_language.p4_documents,
    "p4_segments": p4_language.p4_segments,
    "p5_found": p5_survivor.p5_found,
    "p5_survivors": p5_survivor.p5_survivors,
    "p5_golden": p5_survivor.p5_golden,
    "p7_found": p7_names.p7_found,
    "p7_entities": p7_names.p7_entities,
    "p8_found": p8_contamination.p8_found,
    "p8_alignments": p8_contamination.p8_alignments,
    "p8_items": p8_contamination.p8_items,
    "p9_mixture": p9_mixture.p9_mixture,
    "p9_shares": p9_mixture.p9_shares,
    "p9_tokens": p9_mixture.p9_tokens,
    "p9_mixture_chars": p9_mixture.p9_mixture_chars,
    "p9_shares_chars": p9_mixture.p9_shares_chars,
    "p10_found": p10_repetition.p10_found,
    "p10_repetition": p10_repetition.p10_repetition,
}
SQL = p1_distinctive.SQL | p5_survivor.SQL | sql.SQL
