"""All queries of the subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import chroma, decontaminate, hard_negatives, importance, line_templates, main_text, ngram_join, pieces, prefix_trie, simhash, surrogates, token_files, url_filter

_MODULES = (chroma, line_templates, decontaminate, pieces, ngram_join, surrogates, main_text, importance, token_files, url_filter, prefix_trie, hard_negatives, simhash)

QUERIES: dict[str, Callable] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in getattr(m, "ORACLES", {}).items()}
