"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality rules reject documents; line dedup cuts repeated chunks out of texts; of each group of near duplicates one document stays;
documents with a benchmark span go; what is left is packed into sequences. All stages but the last return the columns of documents.
Empty tables pass through as empty tables.
"""

from __future__ import annotations

from strandline.llm.common import cut
from strandline.llm.op2_lines import line_stage
from strandline.llm.op3_quality import quality_stage
from strandline.llm.op5_pack import packing_stage
from strandline.llm.op9_join import near_duplicate_stage
from strandline.llm.op10_decontaminate import decontamination_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Hashing, MinHash and packing have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
