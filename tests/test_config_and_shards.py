import pytest
from oracle import SF
from pyspark.sql import functions as F

from gridloom.config import Extraction
from gridloom.sources import shards
from gridloom.sources.tables import derived_tasks


@pytest.mark.parametrize("bad", [{}, {"manifest": "m", "dataset": "d"}, {"upload": True}, {"activation": "x"}, {"machine": 2, "machines": 2}, {"host": 1}, {"batch": 3, "hosts": 2}, {"layers": ()}, {"prompt_version": "x"}, {"encoder": "x()"}, {"topology": "x"}, {"topology": "v5e-64", "batch": 6}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        Extraction(**({"dataset": "d"} | bad if bad else {}))


def test_folders():
    assert Extraction("d").folder == "activations"
    assert Extraction("d", host=3, hosts=4).folder == "activations/host_03"


@pytest.mark.parametrize("drop", [True, False])
def test_sharded_dataset(spark, tmp_path, drop):
    tasks = derived_tasks(spark, SF).select((F.col("key") - F.min("key").over(__import__("pyspark").sql.Window.partitionBy())).alias("idx"), "task_id", "train", "test").where("idx < 100")
    about = shards.write(tasks, str(tmp_path / "s"), 7, 2000, drop_remainder=drop).collect()
    assert sum(r["tasks"] for r in about) == (98 if drop else 100)
    assert all(r["bytes"] <= 2000 or r["tasks"] == 1 for r in about)
    got = shards.read(spark, str(tmp_path / "s"), 2).orderBy("line_idx")
    assert [r["task_id"] for r in got.collect()] == [r["task_id"] for r in tasks.where("idx >= 28 and idx < 42").orderBy("idx").collect()]
