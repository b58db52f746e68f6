"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from litsieve.llm import licenses
from litsieve.llm.align import op13_token_alignment
from litsieve.llm.decontam import op3_benchmark_decontamination
from litsieve.llm.jaccard import op6_ngram_jaccard_join
from litsieve.llm.licenses import op4_license_scan
from litsieve.llm.mixing import op11_entropy_mixing
from litsieve.llm.packing import op1_best_fit_packing
from litsieve.llm.periodic import op12_periodic_runs
from litsieve.llm.perplexity import op2_kneser_ney_quality
from litsieve.llm.pii import op10_pii_anchors
from litsieve.llm.sstable import op5_token_sstable
from litsieve.llm.topk import op9_exact_topk
from litsieve.llm.toxicity import op8_toxicity_nnpu
from litsieve.llm.warc import op7_warc_normaliser

_QUERIES = (
    op1_best_fit_packing,
    op2_kneser_ney_quality,
    op3_benchmark_decontamination,
    op4_license_scan,
    op5_token_sstable,
    op6_ngram_jaccard_join,
    op7_warc_normaliser,
    op8_toxicity_nnpu,
    op9_exact_topk,
    op10_pii_anchors,
    op11_entropy_mixing,
    op12_periodic_runs,
    op13_token_alignment,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    own = {"op4_license_scan": licenses.oracle()}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
