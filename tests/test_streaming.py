from netsets.streaming.edges import current, edge_stream, keep_latest


def test_last_weight_wins_over_batches(spark, tmp_path):
    into, table, mark = tmp_path / "in", str(tmp_path / "net"), str(tmp_path / "mark")
    into.mkdir()

    def run():
        query = keep_latest(edge_stream(spark, str(into), 1), table, mark)
        query.awaitTermination(120)
        assert query.exception() is None
        return {tuple(r) for r in current(spark, table).collect()}

    (into / "1.txt").write_text("b a 0.5\nc c 1\nc d\n")
    assert run() == {("a", "b", 0.5), ("c", "d", 1.0)}
    (into / "2.txt").write_text("a b 0.9\ne f 2\n")
    assert run() == {("a", "b", 0.9), ("c", "d", 1.0), ("e", "f", 2.0)}
    assert current(spark, table, below=0) is None
