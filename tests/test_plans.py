"""Queries whose plans matter, on small tables of their own."""

from quarry.plans import graph_queries as G


def test_lines_of_one_document_make_no_edges(spark, tmp_path):
    docs = [(1, "a\nb\na"), (2, "c\nb"), (3, "x\nx"), (4, None), (5, ""), (6, "c\n\n"), (7, "z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    e = G._line_edges(spark, str(tmp_path))
    assert {tuple(r) for r in e.collect()} == {(2, 1), (6, 2)}
    assert dict(map(tuple, G.wcc_sizes(spark, str(tmp_path)).collect())) == {3: 1, 1: 4}


def test_component_stats_need_no_sorted_minima(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"S{k}") for k in range(3)], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"n{k}", "T") for k in range(5)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, 0, 0, "A", 0.1), (1, 2, 0, 1, "B", 0.1), (2, 1, 1, 1, "A", 0.1), (2, 7, 2, 2, "A", 0.1), (3, 1, 2, 3, "A", 0.1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_suppkey long, l_partkey long, l_returnflag string, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    sizes = G.component_sizes
    monkeypatch.setattr(G, "component_sizes", lambda e, n: seen.append((dict(e.dtypes), dict(n.dtypes))) or sizes(e, n))
    assert tuple(G.component_stats(spark, str(tmp_path)).first()) == (4, 4, 2)
    assert seen == [({"u": "bigint", "v": "bigint"}, {"id": "bigint"})]
