"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from quillgraph.llm.byte_bpe import round_trip_digest
from quillgraph.llm.centroids import CENTROIDS_SQL, centroid_clusters
from quillgraph.llm.common import read
from quillgraph.llm.decontaminate import find_leaks
from quillgraph.llm.hard_negatives import HARD_NEGATIVES_SQL, hard_negatives
from quillgraph.llm.licenses import scan_licenses
from quillgraph.llm.line_dedup import LINE_DEDUP_SQL, line_dedup_digest
from quillgraph.llm.minhash import NEAR_DUPLICATES_SQL, NGRAM_SQL, near_duplicates
from quillgraph.llm.nearest import nearest_vectors
from quillgraph.llm.ngram_join import ngram_components
from quillgraph.llm.quality import quality_scores
from quillgraph.llm.secrets import scan_secrets
from quillgraph.llm.token_counts import count_tokens
from quillgraph.llm.toxicity import toxic_documents


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


QUERIES = {
    "op1_toxicity": lambda spark, d: toxic_documents(_docs(spark, d), read(spark, d, "labels")),
    "op2_quality": lambda spark, d: quality_scores(_docs(spark, d), read(spark, d, "labels")),
    "op3_token_counts": lambda spark, d: count_tokens(_docs(spark, d), public_tokenizers.path("word_bpe_49k.json")),
    "op4_nearest": lambda spark, d: nearest_vectors(read(spark, d, "embeddings")),
    "op5_line_dedup": lambda spark, d: line_dedup_digest(_docs(spark, d)),
    "op6_ngram_join": lambda spark, d: ngram_components(_docs(spark, d)),
    "op7_decontaminate": lambda spark, d: find_leaks(_docs(spark, d), read(spark, d, "benchmark")),
    "op8_secrets": lambda spark, d: scan_secrets(_docs(spark, d)),
    "op9_byte_bpe": lambda spark, d: round_trip_digest(_docs(spark, d), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op10_licenses": lambda spark, d: scan_licenses(_docs(spark, d)),
    "op11_hard_negatives": lambda spark, d: hard_negatives(read(spark, d, "embeddings")),
    "op12_minhash": lambda spark, d: near_duplicates(_docs(spark, d)),
    "op13_centroids": lambda spark, d: centroid_clusters(read(spark, d, "embeddings")),
}

ORACLES = {
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op6_ngram_join": NGRAM_SQL,
    "op11_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_minhash": NEAR_DUPLICATES_SQL,
    "op13_centroids": CENTROIDS_SQL,
}
