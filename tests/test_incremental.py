import random
from dataclasses import replace

import pytest

from lociflow.plans.contracts import Preprocessing
from lociflow.streaming import incremental

CFG = Preprocessing(window_size=100, window_stride=50, locus_block_size=400, min_sequence_length=100)
SCHEMA = "sample_id string, individual_id string, contig string, sequence string, source string"


def add(spark, tmp_path, name, config):
    seq = "".join(random.Random(name).choice("ACGT") for _ in range(8000))
    spark.createDataFrame([(name, "i", "c", seq, "reference")], SCHEMA).write.mode("append").parquet(f"file://{tmp_path}/in")
    incremental.follow(spark, f"file://{tmp_path}/in", SCHEMA, config, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()


def samples(spark, tmp_path):
    return {r.sample_id for r in spark.read.parquet(f"file://{tmp_path}/out").select("sample_id").distinct().collect()}


@pytest.mark.parametrize("other,said", [({"split_seed": "another"}, "stored locus"), ({"locus_block_size": 500}, "stored window")])
def test_a_batch_that_contradicts_a_stored_one_fails(spark, tmp_path, other, said):
    add(spark, tmp_path, "a", CFG)
    with pytest.raises(Exception, match=said):
        add(spark, tmp_path, "b", replace(CFG, **other))
    assert samples(spark, tmp_path) == {"a"}
    add(spark, tmp_path, "c", CFG)  # the failed batch runs again with settings that agree
    assert samples(spark, tmp_path) == {"a", "b", "c"}
    assert not (tmp_path / "out" / "batch=1" / "_manifest").exists() and (tmp_path / "out" / "_manifest" / "batch=1").exists()
