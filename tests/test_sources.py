import random

import pytest

from dagloom.graph import TaskGraph
from dagloom.sources.text import append_results, dot_lines, harness_averages, read_graph, read_results, write_dot, write_graph

TEXT = '3\n"a";\n"b";\n"c";\n"a" -> "b";\n"b" -> "c";\n"a" -> "b";\n'


def test_read_and_write(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TEXT)
    g = read_graph(spark, str(tmp_path / "g.txt"))
    assert sorted((r.node_id, r.name) for r in g.nodes.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert sorted((r.edge_seq, r.src, r.dst) for r in g.edges.collect()) == [(0, 0, 1), (1, 1, 2), (2, 0, 1)]
    write_graph(g, str(tmp_path / "out"))
    again = read_graph(spark, str(tmp_path / "out" / "graph_id=0"))
    assert sorted(map(tuple, again.edges.drop("graph_id").collect())) == sorted(map(tuple, g.edges.drop("graph_id").collect()))
    lines = [r.line for r in dot_lines(g).orderBy("line_no").collect()]
    assert lines == ["digraph {", '"a";', '"b";', '"c";', '"a" -> "b";', '"b" -> "c";', '"a" -> "b";', "}"]


@pytest.mark.parametrize("text", ['1\n"a";\n"a" -> "x";\n', '2\n"a";\n'])
def test_bad_files(spark, tmp_path, text):
    (tmp_path / "g.txt").write_text(text)
    g = read_graph(spark, str(tmp_path / "g.txt"))
    with pytest.raises(Exception, match="no such node|node count"):
        g.nodes.collect()
        g.edges.collect()


def test_results(spark, tmp_path):
    lines = [("x", 1, 1, "run time: 99 us"), ("x", 1, 2, "run time: 10 us"), ("x", 2, 1, "run time: 13 us"), ("x", 2, 2, "noise"), ("x", 3, 7, "run time: 12 us"), ("x", 3, 8, "extra: 5")]
    log = spark.createDataFrame(lines, "benchmark string, run int, line_no int, line string")
    found = harness_averages(log)
    assert sorted(map(tuple, found.collect())) == [("x", "extra", None), ("x", "run time", 11.666666)]
    for _ in range(2):
        append_results(found, str(tmp_path / "csv"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("call=*/part-*.csv")))
    first, *rest = text.splitlines()
    assert first == "benchmark,metric,average" and len(rest) == 4 and sorted(rest[:2]) == sorted(rest[2:])
    again = read_results(spark, str(tmp_path / "csv"), "benchmark string, metric string, average double")
    assert sorted(map(tuple, again.collect())) == sorted([*map(tuple, found.collect())] * 2)


def test_files_in_blocks(spark, tmp_path):
    """Large files are read in several blocks, and graphs written in several
    files, without losing the order of lines."""
    rng = random.Random(1)
    texts = {}
    for name, n in (("a", 900), ("b", 3)):
        names = [f"node {rng.randrange(10**6)} {i}" for i in range(n)]
        pairs = [sorted(rng.sample(range(n), 2)) for _ in range(2 * n)]
        texts[name] = names, pairs
        lines = [str(n), *(f'"{x}";' for x in names), *(f'"{names[a]}" -> "{names[b]}";' for a, b in pairs)]
        (tmp_path / f"{name}.txt").write_text("\r\n".join(lines) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
        g = read_graph(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
        write_graph(TaskGraph(g.nodes.repartition(3), g.edges.repartition(3)), str(tmp_path / "out"))
        write_dot(g, str(tmp_path / "dot"))
        for h in (g, read_graph(spark, str(tmp_path / "out" / "graph_id=*"))):
            for k, name in enumerate(("a", "b")):
                names, pairs = texts[name]
                nodes = h.nodes.where(f"graph_id = {k}").orderBy("node_seq").collect()
                edges = h.edges.where(f"graph_id = {k}").orderBy("edge_seq").collect()
                assert [r.name for r in nodes] == names
                assert [[r.src, r.dst] for r in edges] == pairs
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    dot = "".join(f.read_text() for f in sorted((tmp_path / "dot" / "graph_id=1").glob("part-*")))
    names, pairs = texts["b"]
    assert dot.splitlines() == ["digraph {", *(f'"{x}";' for x in names), *(f'"{names[a]}" -> "{names[b]}";' for a, b in pairs), "}"]
