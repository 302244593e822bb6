"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, automaton, chat, fingerprint, lines, media, mixing, neardup, packing, runs, secrets, store, tokens, toxicity


def _stored(name, query):
    def run(spark, sf_dir):
        """The query's stored result; its scratch tables are deleted."""
        with store.small_batches(spark), store.scratch():
            return store.stored(query(spark, sf_dir), name, keep=1)

    return run


def queries() -> dict:
    made = {
        "op1_token_files": tokens.op1_token_files,
        "op2_preference_format": chat.op2_preference_format,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_fingerprints": fingerprint.op4_fingerprints,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_media": media.op6_media,
        "op7_secrets": secrets.op7_secrets,
        "op8_packing": packing.op8_packing,
        "op9_line_dedup": lines.op9_line_dedup,
        "op10_mixing": mixing.op10_mixing,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_bpe_automaton": automaton.op13_bpe_automaton,
    }
    return {name: _stored(name, f) for name, f in made.items()}


def oracle_sql() -> dict[str, str]:
    return {"op2_preference_format": chat.OP2_SQL, "op9_line_dedup": lines.OP9_SQL, "op10_mixing": mixing.OP10_SQL}
