"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from loomseek.llm import chat, decontamination, media, minhash, mixing, passages, secrets, sharding, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_collinear_passages": passages.op1,
        "op2_prefix_target_chat": chat.op2,
        "op3_minimax_shards": sharding.op3,
        "op4_content_addressed_warc": warc.op4,
        "op5_bbit_minhash": minhash.op5,
        "op6_size_partitioned_containment": decontamination.op6,
        "op7_folded_lexicon": toxicity.op7,
        "op8_entropy_secrets": secrets.op8,
        "op9_wav_fingerprints": media.op9,
        "op10_pareto_mix": mixing.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op2_prefix_target_chat": chat.SQL,
        "op3_minimax_shards": sharding.SQL,
        "op4_content_addressed_warc": warc.SQL,
        "op5_bbit_minhash": minhash.SQL,
        "op6_size_partitioned_containment": decontamination.SQL,
        "op10_pareto_mix": mixing.SQL,
    }
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
