"""The operators as queries over the test tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import (
    chat, decontam, licenses, mixing, negatives, quality, repeats, search, sharding, simhash, tokens, toxicity, urls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.run,
    "op2_tokens": tokens.run,
    "op3_sharding": sharding.run,
    "op4_simhash": simhash.run,
    "op5_licenses": licenses.run,
    "op6_toxicity": toxicity.run,
    "op7_quality": quality.run,
    "op8_chat": chat.run,
    "op9_decontamination": decontam.run,
    "op10_urls": urls.run,
    "op11_search": search.run,
    "op12_repeats": repeats.run,
    "op13_negatives": negatives.run,
}

SQL: dict[str, str] = {
    "op8_chat": chat.SQL,
    "op9_decontamination": decontam.SQL,
    "op11_search": search.SQL,
    "op12_repeats": repeats.SQL,
    "op13_negatives": negatives.SQL,
}
