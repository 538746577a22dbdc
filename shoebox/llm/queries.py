"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import centroid_clustering, decontamination, licenses, mixing, near_dedup, pii, quality_classifier, quality_rules, token_store, toxicity, url_filters, warc, whitening

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_licenses": licenses.op2_licenses,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_pii": pii.op4_pii,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "quality_ablations": quality_rules.quality_ablations,
    "op7_token_store": token_store.op7_token_store,
    "op8_warc": warc.op8_warc,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op1_url_filters": url_filters.ORACLE,
    "op2_licenses": licenses.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "quality_ablations": quality_rules.ABLATIONS_ORACLE,
    "op8_warc": warc.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op12_centroid_clustering": centroid_clustering.ORACLE,
}
