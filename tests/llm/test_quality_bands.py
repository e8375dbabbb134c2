"""What the bands of the quality rules reject and keep on the labelled documents."""

import numpy as np
import pytest
from helpers import save
from pyspark.sql import functions as F

from landshift.llm import quality_rules

ROOT = "/root/testdata/sf0.01"


def kept_shares(spark, folder):
    """Shares kept of the good and of the poor documents that pass the base rules."""
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    got = [r for r in quality_rules.op7_quality_rules(spark, folder).collect() if not r["base_failed"]]
    return [np.mean([r["kept"] for r in got if quality.get(r["doc_id"]) == q]) for q in (1, 0)]


@pytest.mark.parametrize("copied", [177])
def test_a_third_of_copies_does_not_move_the_bands(spark, tmp_path, copied):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    copies = docs.where(F.col("doc_id") == copied).crossJoin(spark.range(docs.count() // 2)).withColumn("doc_id", 1_000_000 + F.col("id")).drop("id")
    save(docs.unionByName(copies), tmp_path)
    assert kept_shares(spark, str(tmp_path)) == kept_shares(spark, ROOT)


def test_poor_documents_are_rejected_and_clean_ones_kept(spark):
    good, poor = kept_shares(spark, ROOT)
    assert good > 0.99 and poor < 0.3
