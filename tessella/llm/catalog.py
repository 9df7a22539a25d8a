"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline
from tessella.llm import collocations, decontaminate, exponion, fingerprint, jaccard_join, line_dedup, mixing, pii, quality_rules, sharding, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_shard": sharding.op2_shard,
    "op3_mix": mixing.op3_mix,
    "op4_warc": warc.op4_warc,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_personal_data": pii.op7_personal_data,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_exponion": exponion.op11_exponion,
    "op12_quality": quality_rules.op12_quality,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op1_line_dedup": line_dedup.OP1_SQL, "op4_warc": warc.OP4_SQL, "op11_exponion": exponion.OP11_SQL, "op12_quality": quality_rules.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
