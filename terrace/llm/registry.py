"""Queries of this subpackage, and the SQL that states them where SQL can."""

from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL
from corpus_pipeline import run

from .chatformat import OP2_SQL, op2_perspective_rotation
from .decontaminate import op4_spaced_seeds
from .divergence import OP13_SQL, op13_source_divergence
from .jaccard import op11_combination_prefixes
from .kneser_ney import op1_kneser_ney
from .mixing import OP3_SQL, op3_hierarchical_mixing
from .quality import OP9_SQL, op9_quality_cascade
from .runs import op12_lyndon_runs
from .secrets import op7_secret_linking
from .simhash import op6_simhash_bktree
from .tokencount import op10_rank_synchronous_bpe
from .toxicity import op8_weak_supervision
from .urlfilter import OP5_SQL, op5_link_graph

QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_perspective_rotation": op2_perspective_rotation,
    "op3_hierarchical_mixing": op3_hierarchical_mixing,
    "op4_spaced_seeds": op4_spaced_seeds,
    "op5_link_graph": op5_link_graph,
    "op6_simhash_bktree": op6_simhash_bktree,
    "op7_secret_linking": op7_secret_linking,
    "op8_weak_supervision": op8_weak_supervision,
    "op9_quality_cascade": op9_quality_cascade,
    "op10_rank_synchronous_bpe": op10_rank_synchronous_bpe,
    "op11_combination_prefixes": op11_combination_prefixes,
    "op12_lyndon_runs": op12_lyndon_runs,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_perspective_rotation": OP2_SQL,
    "op3_hierarchical_mixing": OP3_SQL,
    "op5_link_graph": OP5_SQL,
    "op9_quality_cascade": OP9_SQL,
    "op13_source_divergence": OP13_SQL,
}

if PIPELINE_SQL:
    ORACLE_SQL["pipeline"] = PIPELINE_SQL
