"""The registered queries of this subpackage and, where SQL can say it, their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .archives import op1_warc
from .common import table
from .language import op2_language
from .licences import ORACLE as LICENCE_SQL
from .licences import op3_licences
from .manifest import op13_manifest
from .mixing import op10_mixing
from .negatives import ORACLE as NEGATIVES_SQL
from .negatives import op12_negatives
from .passages import op6_passages
from .pieces import op9_sentencepiece
from .postings import op11_nearest
from .quality import ORACLE as QUALITY_SQL
from .quality import op4_quality
from .secret_scan import op7_secrets
from .simhash import op8_simhash
from .topk import ORACLE as TOPK_SQL
from .topk import op5_topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, source: str, fn: Callable[..., DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(table(spark, sf_dir, source))
    if oracle is not None:
        ORACLES[name] = oracle


_register("op8_covering_simhash", "documents", op8_simhash)
_register("op9_sentencepiece", "documents",
          lambda docs: op9_sentencepiece(docs, public_tokenizers.path("piece_bpe_32k.model")))
_register("op7_secret_novelty", "documents", op7_secrets)
_register("op10_entropy_mixing", "documents", op10_mixing)
_register("op2_language_hierarchy", "documents", op2_language)
_register("op4_quality_divergence", "documents", op4_quality, QUALITY_SQL)
_register("op1_arc_to_warc", "pages", op1_warc)
_register("op5_segment_topk", "embeddings", op5_topk, TOPK_SQL)
_register("op3_licence_digests", "documents", op3_licences, LICENCE_SQL)
_register("op6_chained_passages", "documents", op6_passages)
_register("op13_merkle_manifest", "documents", op13_manifest)
_register("op12_hard_negatives", "embeddings", op12_negatives, NEGATIVES_SQL)
_register("op11_posting_lists", "embeddings", op11_nearest)
