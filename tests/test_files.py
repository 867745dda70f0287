import os

from netsets.operators.evidence import clean
from netsets.sources import files as R


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def read_back(path):
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    return "".join(open(os.path.join(path, f)).read() for f in parts).splitlines()


def test_edges(spark, tmp_path):
    p = put(tmp_path, "e.txt", "b a 0.5\na\tb  0.7\nc c 1\n\na c 0.9\n")
    got = R.read_edges(spark, p)
    assert rows(got) == [("a", "b", 0.7), ("a", "c", 0.9)]
    assert rows(R.read_edges(spark, put(tmp_path, "e.csv", "u,v,w\nx,y,2\n"))) == [("x", "y", 2.0)]
    assert rows(R.read_edges(spark, put(tmp_path, "f.csv", "p1,p2,weight\nx,y,2\n"))) == [("x", "y", 2.0)]
    assert rows(R.read_edges(spark, put(tmp_path, "n.tsv", "x\ty\tNEG\n"), header=False, weighted=False)) == [("x", "y", 1.0)]
    R.write_edges(got, str(tmp_path / "out"))
    assert read_back(tmp_path / "out") == ["a c 0.9", "a b 0.7"]
    assert rows(R.read_composite(spark, put(tmp_path, "c.tsv", "a\tb\tPPI\t0.1\na\tc\tLIT\t0.2\n"), "LIT")) == [("a", "c", 0.2)]


def test_sets(spark, tmp_path):
    p = put(tmp_path, "s.txt", "a b a\n\nc d e \n")
    sets = R.read_sets(spark, p)
    assert rows(sets) == [("1", "a"), ("1", "b"), ("2", "c"), ("2", "d"), ("2", "e")]
    assert rows(R.read_sets(spark, p, upper=True, least=3)) == [("2", "C"), ("2", "D"), ("2", "E")]
    long = R.read_long_sets(spark, put(tmp_path, "l.tsv", "y1\t3\ny2\t3\n"))
    assert rows(long) == [("3", "Y1"), ("3", "Y2")] and rows(R.long_to_lines(long)) == [("Y1 Y2",)]
    scored = spark.createDataFrame([("1", 0.5), ("2", 1.25)], "cid string, score double")
    R.write_scored_sets(sets, scored, str(tmp_path / "out"))
    assert read_back(tmp_path / "out") == ["(3_1.250000): c d e", "(2_0.500000): a b"]
    back = R.read_scored_sets(spark, str(tmp_path / "out"))
    assert [(r.cid, r.score, r.node) for r in back.orderBy("cid", "pos").collect()][:3] == [("1", 1.25, "c"), ("1", 1.25, "d"), ("1", 1.25, "e")]
    named = put(tmp_path, "n.txt", "C7|2|A,B|(2_0.5): p q\n")
    assert rows(R.read_scored_sets(spark, named)) == [("C7", 0.5, "A,B", 0, "p"), ("C7", 0.5, "A,B", 1, "q")]
    assert rows(R.strip_names(R.lines(spark, named))) == [("(2_0.5): p q",)]
    R.write_sets(sets, str(tmp_path / "plain"))
    assert read_back(tmp_path / "plain") == ["c d e", "a b"]


def test_mappings_and_projections(spark, tmp_path):
    m = R.read_mapping(spark, put(tmp_path, "m.tsv", "From\tTo\nP1\tsce:A\nP2\tsce:B\n"), "sce:")
    pairs = spark.createDataFrame([("P2", "P1"), ("P1", "P9")], "u string, v string")
    assert rows(R.remap(pairs, m)) == [("A", "B")]
    assert rows(R.distinct_ids(pairs)) == [("P1",), ("P2",), ("P9",)]
    assert rows(R.project_columns(spark, put(tmp_path, "p.tsv", "h0\th1\th2\nx0\tx1\tx2\ny0\ty1\ty2\n"), [0, 2], skip=1)) == [("h0 h2",), ("y0 y2",)]
    ev = R.read_evidence(spark, put(tmp_path, "ev.tsv", "a\tb\tPPI\t0.2\nB\tA\tPPI\t-0.9\na\ta\tPPI\t1\na\tc\t\t\n"))
    assert rows(clean(ev)) == [("A", "B", "PPI", -0.9), ("A", "C", "Undefined", 1.0)]


def test_blocks_and_sections(spark, tmp_path):
    x = R.read_cross_validation(spark, put(tmp_path, "x.txt", "iter\t0\n1\n7\niter\t1\n2\n"))
    assert rows(x) == [(0, "1"), (0, "7"), (1, "2")]
    hubs, edges = R.read_hubs(spark, put(tmp_path, "h.txt", "hubs\na\t50\nedges\na|b\t0.5\n"))
    assert rows(hubs) == [("a", 50)] and rows(edges) == [("a", "b", 0.5)]
    assert [r.value for r in R.hub_lines(hubs, edges).collect()] == ["hubs", "a\t50", "edges", "a|b\t0.5"]
    blocks = put(tmp_path, "b.txt", "Complex 1\nCore: a b\nAttachments: c\nComplex 2\nz\n")
    assert rows(R.read_block_clusters(spark, blocks)) == [("1", "a"), ("1", "b"), ("1", "c")]
    assert rows(R.read_line_clusters(spark, put(tmp_path, "t.txt", "a\tb\nz\n"))) == [("1", "a"), ("1", "b")]


def test_tables(spark, tmp_path):
    wide = spark.createDataFrame([(0.5, 1.0, 1), (0.1, 0.0, 0)], "A double, B double, cls int")
    R.write_arff(wide, str(tmp_path / "arff"), "edges", ["A", "B"], "cls")
    assert read_back(tmp_path / "arff") == ["@relation edges", "@attribute A numeric", "@attribute B numeric", "@attribute cls {0,1}", "@data", "0.1,0.0,0", "0.5,1.0,1"]
    R.append_metrics(wide.limit(1), str(tmp_path / "m"))
    R.append_metrics(wide.limit(1), str(tmp_path / "m"))
    assert rows(R.read_metrics(spark, str(tmp_path / "m"))) == [("0.5", "1.0", "1")] * 2
    assert (tmp_path / "m" / "header.csv").read_text() == "A,B,cls\n" and sum("A,B" in line for line in read_back(tmp_path / "m")) == 0
    R.write_table(wide, str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == 2


def test_iterations(spark, tmp_path):
    put(tmp_path, "found iter0.txt", "(2_0.5): a b\n")
    put(tmp_path, "found iter1.txt", "(3_0.25): a b c\n(2_0.1): d e\n")
    got = R.read_iterations(spark, str(tmp_path / "found"), 2)
    assert sorted((r.iteration, r.cid, r.score, r.node) for r in got.collect()) == [(0, "1", 0.5, "a"), (0, "1", 0.5, "b"), *[(1, "1", 0.25, x) for x in "abc"], (1, "2", 0.1, "d"), (1, "2", 0.1, "e")]


def test_lines_over_many_partitions(spark, tmp_path):
    """Files of several blocks: numbers and headers go on from one partition to the next."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        names = [f"n{i:04d}" for i in range(300)]
        p = put(tmp_path, "s.txt", "\n".join(names))
        assert R.lines(spark, p).rdd.getNumPartitions() > 5
        assert {(r.cid, r.node) for r in R.read_sets(spark, p).collect()} == {(str(i + 1), n) for i, n in enumerate(names)}
        x = put(tmp_path, "x.txt", "".join(f"iter\t{i}\n" + "".join(f"{j}\n" for j in range(i * 7 % 60)) for i in range(25)))
        assert sorted((r.iteration, int(r.cid)) for r in R.read_cross_validation(spark, x).collect()) == sorted((i, j) for i in range(25) for j in range(i * 7 % 60))
        b = put(tmp_path, "b.txt", "".join(f"Complex {i}\n" + "".join(f"m{i}-{j}\n" for j in range(2 + i)) for i in range(30)))
        assert {(r.cid, r.node) for r in R.read_block_clusters(spark, b).collect()} == {(str(i + 1), f"m{i}-{j}") for i in range(30) for j in range(2 + i)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
