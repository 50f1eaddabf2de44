"""Registered queries of the package: one per operator, and the pipeline."""

from __future__ import annotations

from paddock.llm.bpe import op5_bpe
from paddock.llm.centroids import op11_centroid_clustering
from paddock.llm.convnet import op6_quality_classifier
from paddock.llm.fingerprint import op8_document_fingerprints
from paddock.llm.jaccard import op1_ngram_jaccard_join
from paddock.llm.manifest import op12_merkle_manifest
from paddock.llm.neighbours import op13_embedding_near_dedup
from paddock.llm.packing import op4_best_fit_packing
from paddock.llm.passages import op10_substring_dedup
from paddock.llm.rules import op2_quality_rules
from paddock.llm.secrets import op3_secret_scans
from paddock.llm.shards import op7_sharding
from paddock.llm.sql import ORACLE  # noqa: F401
from paddock.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_rules, op3_secret_scans, op4_best_fit_packing, op5_bpe, op6_quality_classifier,
                                   op7_sharding, op8_document_fingerprints, op9_toxicity, op10_substring_dedup, op11_centroid_clustering,
                                   op12_merkle_manifest, op13_embedding_near_dedup)}
