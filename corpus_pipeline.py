"""Documents -> packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and reads what its predecessor wrote. All but
the last return the columns of documents.

* toxicity: documents predicted toxic go;
* near-dedup: of each component of near duplicates the document with the smallest id
  stays, and once where its row repeats; documents without words are in no component;
* suffix-array dedup: bytes of strings of 200 bytes that also start elsewhere go, from
  every place; characters cut at an edge go whole; n_chars follows the text; a document
  with nothing left stays, empty;
* mixing: a row per copy that the mix takes, so a document may repeat or go; documents
  without words have nothing to take and are kept once;
* packing: a row per piece with its sequence and place.
"""

import os
import sys

import public_tokenizers
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsmill.llm import arrays, mixing, near_dedup, packing, suffix_dedup, toxicity
from newsmill.session import run_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
ORACLE_SQL = None  # a trained classifier and byte-pair encoding; tests compare with brute force


def drop_toxic(spark, docs, sf_dir):
    arrays.ready(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark, docs, sf_dir):
    return near_dedup.keep_one(docs)


def drop_repeated_strings(spark, docs, sf_dir):
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark, docs, sf_dir):
    return mixing.draw(docs)


def pack(spark, docs, sf_dir):
    return packing.best_fit_packing(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeated_strings),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
