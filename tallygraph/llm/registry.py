"""Queries of this subpackage, by name; ``pipeline`` is in corpus_pipeline."""

from __future__ import annotations

from . import audit, centroids, embdedup, linededup, substrings
from .ann import op2_ann
from .audit import op12_filter_audit
from .bpe import op6_bpe
from .centroids import op11_centroids
from .embdedup import op4_embedding_dedup
from .langid import op8_langid
from .linededup import op3_line_dedup
from .packing import op9_packing
from .secretscan import op10_secrets
from .simhash import op1_simhash
from .substrings import op13_substring_dedup
from .toxicity import op7_toxicity
from .urlfilter import op5_urls

QUERIES = {f.__name__: f for f in (op1_simhash, op2_ann, op3_line_dedup, op4_embedding_dedup, op5_urls, op6_bpe, op7_toxicity, op8_langid, op9_packing, op10_secrets, op11_centroids, op12_filter_audit, op13_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op3_line_dedup": linededup.ORACLE_SQL, "op4_embedding_dedup": embdedup.ORACLE_SQL, "op11_centroids": centroids.ORACLE_SQL, "op12_filter_audit": audit.ORACLE_SQL, "op13_substring_dedup": substrings.ORACLE_SQL}
