from __future__ import annotations

from tidetrace.llm.common import with_row_id


def test_row_id_stays(spark, tmp_path):
    """Rows keep their numbers when a later job splits the scan in another way."""
    spark.range(4000).repartition(8).write.parquet(str(tmp_path / "t"))
    rows = with_row_id(spark.read.parquet(str(tmp_path / "t")), "row")
    numbers, cost = [], spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1", "1g"):
            spark.conf.set("spark.sql.files.openCostInBytes", size)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbers.append({r.id: r.row for r in rows.select("id", "row").collect()})
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers[0] == numbers[1]
    assert len(set(numbers[0].values())) == 4000
