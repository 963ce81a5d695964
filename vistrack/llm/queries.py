"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from vistrack.llm import fim, html, licenses, lm, media, merkle, packing, pieces, pii, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash": simhash.query,
        "op2_packing": packing.query,
        "op3_lm_scoring": lm.query,
        "op4_pii_surrogates": pii.query,
        "op5_warc": warc.query,
        "op6_licenses": licenses.query,
        "op7_quality": quality.query,
        "op8_toxicity": toxicity.query,
        "op9_pieces": pieces.query,
        "op10_media": media.query,
        "op11_fill_in_middle": fim.query,
        "op12_html": html.query,
        "op13_merkle": merkle.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": warc.SQL, "op7_quality": quality.SQL, "op11_fill_in_middle": fim.SQL, "op13_merkle": merkle.SQL}
