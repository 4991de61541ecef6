"""Queries of the corpus operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .embeddings import EMBEDDINGS_SQL, embedding_groups
from .language import identify_languages
from .lines import lines_query
from .mixing import mixing_query
from .packing import pack_documents
from .sharding import SHARDING_SQL, sharding_query
from .simhash import simhash_query
from .sketch import fingerprint_documents
from .substring import SUBSTRING_SQL, substring_query
from .warc import WARC_SQL, warc_query

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda s, d: mixing_query(table(s, d, "documents"), table(s, d, "labels")),
    "op2_sharding": lambda s, d: sharding_query(table(s, d, "documents")),
    "op3_simhash": lambda s, d: simhash_query(table(s, d, "documents")),
    "op4_packing": lambda s, d: pack_documents(table(s, d, "documents"), TOKENIZER),
    "op5_language": lambda s, d: identify_languages(table(s, d, "documents")),
    "op6_embeddings": lambda s, d: embedding_groups(table(s, d, "embeddings")),
    "op7_fingerprints": lambda s, d: fingerprint_documents(table(s, d, "documents")),
    "op8_substrings": lambda s, d: substring_query(table(s, d, "documents")),
    "op9_lines": lambda s, d: lines_query(table(s, d, "documents")),
    "op10_warc": lambda s, d: warc_query(table(s, d, "pages")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": SHARDING_SQL,
    "op6_embeddings": EMBEDDINGS_SQL,
    "op8_substrings": SUBSTRING_SQL,
    "op10_warc": WARC_SQL,
}
