"""The queries of this package, by name. Each takes ``(spark, sf_dir)`` and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.bpe import op7_bpe
from quillspark.llm.chat import OP11_SQL, op11_chat
from quillspark.llm.common import table
from quillspark.llm.decontam import op9_decontam
from quillspark.llm.filters import OP12_SQL, op12_filters
from quillspark.llm.licenses import op2_licenses
from quillspark.llm.lm import op10_lm
from quillspark.llm.media import op5_media
from quillspark.llm.pii import op8_pii
from quillspark.llm.runs import op13_runs
from quillspark.llm.sharding import op1_sharding
from quillspark.llm.simhash import op3_simhash
from quillspark.llm.toxicity import op4_toxicity
from quillspark.llm.urls import op6_urls


def _over(run: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(*[table(spark, sf_dir, t) for t in tables])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": _over(op1_sharding, "documents"),
    "op2_licenses": _over(op2_licenses, "documents"),
    "op3_simhash": _over(op3_simhash, "documents"),
    "op4_toxicity": _over(op4_toxicity, "documents", "labels"),
    "op5_media": _over(op5_media, "documents"),
    "op6_urls": _over(op6_urls, "pages"),
    "op7_bpe": _over(op7_bpe, "documents"),
    "op8_pii": _over(op8_pii, "documents"),
    "op9_decontam": _over(op9_decontam, "documents", "benchmark"),
    "op10_lm": _over(op10_lm, "documents"),
    "op11_chat": _over(op11_chat, "conversations"),
    "op12_filters": _over(op12_filters, "documents", "labels"),
    "op13_runs": _over(op13_runs, "documents"),
}

#: The other queries have no SQL form: each iterates, trains a model or runs an automaton; tests use brute force.
ORACLE_SQL: dict[str, str] = {"op11_chat": OP11_SQL, "op12_filters": OP12_SQL}
