"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from .chat import op2_chat_windows
from .exponion import CODES_SQL, op12_exponion_codes
from .forest import op8_hash_prefix_forest
from .merkle import MERKLE_SQL, op11_merkle_manifest
from .mixing import op10_source_schedule
from .multiset import op5_multiset_fingerprints
from .packing import op4_vector_packing
from .pieces import op13_score_agenda_pieces
from .pii import op3_pii_surrogates
from .quality import op1_nb_svm_quality
from .simhash import op7_simhash_near_dedup
from .substrings import op6_repeated_substrings
from .token_output import op9_bit_plane_token_ids

_OPERATORS = (
    op1_nb_svm_quality,
    op2_chat_windows,
    op3_pii_surrogates,
    op4_vector_packing,
    op5_multiset_fingerprints,
    op6_repeated_substrings,
    op7_simhash_near_dedup,
    op8_hash_prefix_forest,
    op9_bit_plane_token_ids,
    op10_source_schedule,
    op11_merkle_manifest,
    op12_exponion_codes,
    op13_score_agenda_pieces,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL, "op12_exponion_codes": CODES_SQL}
