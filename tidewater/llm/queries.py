"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewater.llm.audit import OP13_SQL, op13_filter_audit
from tidewater.llm.bpe import op2_bpe
from tidewater.llm.collisions import OP12_SQL, op12_near_vectors
from tidewater.llm.lm import OP1_SQL, op1_lm_scoring
from tidewater.llm.minhash import op10_minhash
from tidewater.llm.packing import op9_packing
from tidewater.llm.periodic import op11_periodic_runs
from tidewater.llm.preferences import OP7_SQL, op7_preferences
from tidewater.llm.quality import op5_quality
from tidewater.llm.suffix import op3_suffix_array
from tidewater.llm.urls import OP6_SQL, op6_url_filter
from tidewater.llm.vectors import OP4_SQL, op4_exact_top_k, op8_near_neighbours


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    q = [op1_lm_scoring, op2_bpe, op3_suffix_array, op4_exact_top_k, op5_quality, op6_url_filter, op7_preferences, op8_near_neighbours, op9_packing, op10_minhash, op11_periodic_runs, op12_near_vectors, op13_filter_audit, pipeline]
    return {f.__name__: f for f in q}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_scoring": OP1_SQL, "op4_exact_top_k": OP4_SQL, "op6_url_filter": OP6_SQL, "op7_preferences": OP7_SQL, "op12_near_vectors": OP12_SQL, "op13_filter_audit": OP13_SQL}
