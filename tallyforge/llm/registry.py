"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyforge.llm import align, decontam, exact_dedup, jaccard, langid, licenses, minhash, packing, phrases, pii, sharding, substring, url_rules


def queries() -> dict:
    return {
        "op1_slot_sharding": sharding.op1_slot_sharding,
        "op2_license_sentences": licenses.op2_license_sentences,
        "op3_kneser_ney_langid": langid.op3_kneser_ney_langid,
        "op4_digest_dedup": exact_dedup.op4_digest_dedup,
        "op5_seed_alignment": decontam.op5_seed_alignment,
        "op6_config_lp_packing": packing.op6_config_lp_packing,
        "op7_surrogates": pii.op7_surrogates,
        "op8_parity_join": jaccard.op8_parity_join,
        "op9_url_rules": url_rules.op9_url_rules,
        "op10_gear_chunks": substring.op10_gear_chunks,
        "op11_phrases": phrases.op11_phrases,
        "op12_minhash": minhash.op12_minhash,
        "op13_token_alignment": align.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_sentences": licenses.SQL, "op4_digest_dedup": exact_dedup.SQL, "op9_url_rules": url_rules.SQL, "op11_phrases": phrases.SQL}
