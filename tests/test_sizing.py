from pathlib import Path

from rowlore.plans.sizing import clear_scratch, materialize, scratch_dir, scratch_root


def test_scratch_is_the_named_folder_and_can_be_cleared(spark):
    clear_scratch(spark)
    root = scratch_root(spark)
    assert root == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    df = materialize(spark.range(5), "some")
    made = {p.name for p in Path(root).iterdir() if p.name.startswith("some-")}
    assert made and df.count() == 5 and scratch_dir(spark, "other").startswith(root)
    assert clear_scratch(spark) >= 1 and not made & {p.name for p in Path(root).iterdir()}
    assert clear_scratch(spark) == 0
