from __future__ import annotations

from caseloom.operators import governance


def test_files_and_columns(spark, tmp_path):
    rows = [(i, "a" if i < 60 else "b", None if i % 10 == 0 else " " if i % 10 == 1 else "é" * 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, k string, `t.x` string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/one")
    df.repartition(4, "id").write.parquet(f"file://{tmp_path}/many")
    one, many = spark.read.parquet(f"file://{tmp_path}/one"), spark.read.parquet(f"file://{tmp_path}/many")
    size = next(f for f in (tmp_path / "one").glob("*.parquet")).stat().st_size
    assert tuple(governance.table_diagnostics(one).first()) == (1, size, 100, 1, 1.0)
    told = governance.table_diagnostics(many).first()
    assert (told["files"], told["rows"], told["small_files"]) == (4, 100, 4) and 0.2 < told["largest_share"] < 0.5
    sizes = {r["key"]: r for r in governance.relation_sizes(one, "k").collect()}
    assert (sizes["a"]["rows"], sizes["a"]["files"], sizes["b"]["rows"]) == (60, 1, 40)
    assert abs(sizes["a"]["bytes"] - 0.6 * size) <= 1 and sizes["a"]["bytes"] + sizes["b"]["bytes"] in (size - 1, size, size + 1)
    found = {r["column"]: tuple(r)[1:] for r in governance.column_diagnostics(df).collect()}
    assert found == {"id": ("bigint", 100, 0, 0, None), "k": ("string", 100, 0, 0, 1.0), "t.x": ("string", 100, 10, 10, (10 * 1 + 80 * 6) / 90)}
    assert governance.column_diagnostics(df.limit(0)).first()["rows"] == 0
    empty = spark.createDataFrame([], "id long")
    empty.write.parquet(f"file://{tmp_path}/none")
    assert governance.table_diagnostics(spark.read.parquet(f"file://{tmp_path}/none")).first()["rows"] == 0
