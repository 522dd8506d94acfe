"""The corpus queries and the SQL twins of those that SQL can express."""

from liftline.llm import (
    bpe_automaton,
    chat_format,
    chunk_dedup,
    exact_dedup,
    exact_search,
    language_id,
    learned_partitions,
    license_scan,
    merkle_manifest,
    simhash_dedup,
    source_mixing,
    suffix_dedup,
    token_alignment,
)

_MODULES = (
    language_id, chunk_dedup, chat_format, simhash_dedup, exact_search, suffix_dedup, source_mixing, learned_partitions, license_scan, bpe_automaton,
    exact_dedup, token_alignment, merkle_manifest,
)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES |= getattr(_module, "REGISTERED", None) or _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
