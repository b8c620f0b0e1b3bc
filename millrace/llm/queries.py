"""The registered queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from millrace.llm import quality, warc
from millrace.llm.fingerprints import op10_fingerprints
from millrace.llm.minhash import op7_near_duplicates
from millrace.llm.multiindex import op12_embedding_links
from millrace.llm.packing import op6_packing
from millrace.llm.pii import op1_personal_data
from millrace.llm.pieces import op4_sentencepiece
from millrace.llm.quality import op5_quality_rules
from millrace.llm.rans import op2_token_files
from millrace.llm.sharding import op8_sharding
from millrace.llm.toxicity import op3_toxicity
from millrace.llm.turns import op11_turn_structure
from millrace.llm.warc import op9_warc_derivatives
from millrace.llm.whitening import op13_embedding_whitening


def queries() -> dict:
    found = (
        op1_personal_data, op2_token_files, op3_toxicity, op4_sentencepiece, op5_quality_rules, op6_packing, op7_near_duplicates,
        op8_sharding, op9_warc_derivatives, op10_fingerprints, op11_turn_structure, op12_embedding_links, op13_embedding_whitening,
    )
    return {query.__name__: query for query in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality.ORACLE_SQL, "op9_warc_derivatives": warc.oracle_sql()}
