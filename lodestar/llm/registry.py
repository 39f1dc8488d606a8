"""Queries of this subpackage and their SQL."""

from . import decontamination, host_quality, line_dedup, minhash_forest, packing, repeats, secrets, sharding, token_files, warc

_MODULES = (packing, decontamination, sharding, host_quality, repeats, secrets, token_files, minhash_forest, line_dedup, warc)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
