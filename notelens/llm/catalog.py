"""All registered queries of this subpackage; importing the modules registers them."""

from notelens.llm import (  # noqa: F401
    chat_queries, digest_queries, language_queries, license_queries, media_queries, mixing_queries, quality_queries, simhash_queries, spelling_queries,
    substring_queries, token_queries, url_queries, vector_code_queries,
)
from notelens.llm.registry import ORACLES, QUERIES  # noqa: F401
