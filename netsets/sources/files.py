"""Readers and writers of the text shapes that networks and sets come in. Every reader returns a lazy DataFrame with a stated schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.operators.graph import canonical
from netsets.operators.running import numbered, under_headers

#: Lines of one file in order: Spark reads a file's text in order within a partition, and partitions of one file in order.
LINE = "line"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, at: non-empty lines with numbers that rise along each file."""
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return text.select(F.trim("value").alias(LINE), "at").where(F.col(LINE) != "")


def _fields(line: Column, by: str = r"\s+") -> Column:
    return F.split(F.trim(line), by)


def read_edges(spark: SparkSession, path: str, header: bool | None = None, weighted: bool = True) -> DataFrame:
    """u, v, w with u < v, no loops, the last line of a pair wins. Files named .csv or .tsv have a header (u v w or p1 p2 weight) unless
    told otherwise; others are fields between white space. Unweighted reads take the first two fields and weight 1."""
    by = "," if path.endswith(".csv") else "\t" if path.endswith(".tsv") else r"\s+"
    header = path.endswith((".csv", ".tsv")) if header is None else header
    rows = lines(spark, path)
    if header:
        first = _fields(F.col(LINE), by)[0]
        rows = rows.where(~first.isin("u", "p1"))
    f = _fields(F.col(LINE), by)
    w = F.coalesce(F.try_element_at(f, F.lit(3)).cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return canonical(rows.select(f[0].alias("u"), f[1].alias("v"), w.alias("w"), "at"), order="at")


def write_edges(edges: DataFrame, path: str, weighted: bool = True) -> None:
    """One line an edge, heaviest first."""
    row = F.concat_ws(" ", "u", "v", *(["w"] if weighted else []))
    edges.orderBy(F.desc("w"), "u", "v").select(row.alias("value")).write.mode("overwrite").text(path)


def read_composite(spark: SparkSession, path: str, feature: str) -> DataFrame:
    """u, v, w of the rows (u, v, feature, w) of one feature."""
    f = _fields(F.col(LINE), r"\t")
    rows = lines(spark, path).where(f[2] == feature)
    return canonical(rows.select(f[0].alias("u"), f[1].alias("v"), f[3].cast("double").alias("w"), "at"), order="at")


def read_sets(spark: SparkSession, path: str, upper: bool = False, least: int = 1) -> DataFrame:
    """cid, node: one set a line, numbered from 1 in file order, members once each."""
    line = F.upper(LINE) if upper else F.col(LINE)
    rows = numbered(lines(spark, path)).select(line.alias(LINE), F.col("n").cast("string").alias("cid"))
    members = F.array_distinct(_fields(F.col(LINE)))
    return rows.where(F.size(members) >= least).select("cid", F.explode(members).alias("node"))


def read_long_sets(spark: SparkSession, path: str) -> DataFrame:
    """cid, node from lines (node, cid), ids in capitals."""
    f = _fields(F.col(LINE), r"\t")
    return lines(spark, path).select(f[1].alias("cid"), F.upper(f[0]).alias("node")).distinct()


def long_to_lines(sets_x: DataFrame, with_id: bool = False) -> DataFrame:
    """value: one line a set."""
    members = F.array_join(F.sort_array(F.collect_set("node")), " ")
    grouped = sets_x.groupBy("cid").agg(members.alias("m"))
    return grouped.select((F.concat_ws("\t", "cid", "m") if with_id else F.col("m")).alias("value"))


def parse_scored_sets(rows: DataFrame) -> DataFrame:
    """line -> cid, score, pos, node of `name|n|sources|(size_score): a b c`; everything before the bracket is optional."""
    head = F.regexp_extract(LINE, r"^([^(]*)\(", 1)
    score = F.regexp_extract(LINE, r"\((?:[^)_]*_)?([^)_]+)\)", 1).cast("double")
    body = F.regexp_extract(LINE, r"\)\s*:\s*(.*)$", 1)
    sources = F.regexp_extract(head, r"\|([^|]*)\|$", 1)
    name = F.regexp_extract(head, r"^([^|]*)", 1)
    kept = numbered(rows.where(F.col(LINE).contains("(")))
    out = kept.select(F.when(name != "", name).otherwise(F.col("n").cast("string")).alias("cid"), score.alias("score"), sources.alias("sources"), _fields(body).alias("m"))
    return out.select("cid", "score", "sources", F.posexplode("m").alias("pos", "node"))


def read_scored_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_scored_sets(lines(spark, path))


def scored_lines(sets_x: DataFrame, scored: DataFrame, digits: int | None = 6) -> DataFrame:
    """value, score: `(size_score): a b c`, members sorted."""
    m = sets_x.groupBy("cid").agg(F.sort_array(F.collect_set("node")).alias("m"))
    shown = F.format_string(f"%.{digits}f", "score") if digits is not None else F.col("score").cast("string")
    joined = m.join(scored.select("cid", "score"), "cid")
    return joined.select(F.concat(F.lit("("), F.size("m").cast("string"), F.lit("_"), shown, F.lit("): "), F.array_join("m", " ")).alias("value"), "score", "cid")


def write_scored_sets(sets_x: DataFrame, scored: DataFrame, path: str, digits: int | None = 6) -> None:
    """Best first."""
    scored_lines(sets_x, scored, digits).orderBy(F.desc("score"), "cid").select("value").write.mode("overwrite").text(path)


def write_sets(sets_x: DataFrame, path: str) -> None:
    """One line a set, largest first, members sorted."""
    m = sets_x.groupBy("cid").agg(F.sort_array(F.collect_set("node")).alias("m"))
    m.orderBy(F.desc(F.size("m")), "cid").select(F.array_join("m", " ").alias("value")).write.mode("overwrite").text(path)


def append_metrics(row: DataFrame, path: str) -> None:
    """Appends rows; the column names come as one file of their own, written when the path has none yet, and sort before all rows."""
    spark = row.sparkSession
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        fs.mkdirs(where)
        with_names = fs.create(jvm.org.apache.hadoop.fs.Path(where, "header.csv"))
        with_names.write(bytearray((",".join(row.columns) + "\n").encode()))
        with_names.close()
    row.write.mode("append").option("header", False).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """What append_metrics wrote, all columns as text."""
    names = spark.read.text(f"{path.rstrip('/')}/header.csv").first()[0].split(",")
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("pathGlobFilter", "part-*").csv(path)


def read_iterations(spark: SparkSession, base: str, iterations: int, suffix: str = ".txt") -> DataFrame:
    """iteration, cid, score, sources, pos, node of the scored sets in `<base> iter<N><suffix>`, N from 0."""
    read = [read_scored_sets(spark, f"{base} iter{i}{suffix}").select(F.lit(i).alias("iteration"), "*") for i in range(iterations)]
    return reduce(DataFrame.unionByName, read)


def read_mapping(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """from_id, to_id of a two-column table with a header; the prefix of the second is cut off."""
    f = _fields(F.col(LINE), r"\t")
    rows = lines(spark, path).where(f[0] != "From")
    return rows.select(f[0].alias("from_id"), F.regexp_replace(f[1], f"^{prefix}", "").alias("to_id"))


def remap(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """pairs (u, v) with both ends renamed; pairs with an end that has no name go."""
    mu, mv = mapping.select(F.col("from_id").alias("u"), F.col("to_id").alias("nu")), mapping.select(F.col("from_id").alias("v"), F.col("to_id").alias("nv"))
    joined = pairs.select("u", "v").join(mu, "u").join(mv, "v").where("nu <> nv")
    return joined.select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct()


def distinct_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def project_columns(spark: SparkSession, path: str, columns: list[int], by: str = r"\t", skip: int | None = None) -> DataFrame:
    """value: the given fields of each line; `skip` leaves out the line with that number, from 0."""
    f = _fields(F.col(LINE), by)
    rows = lines(spark, path)
    kept = numbered(rows).where(F.col("n") != skip + 1) if skip is not None else rows
    return kept.select(F.concat_ws(" ", *[f[c] for c in columns]).alias("value"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """u, v, subtype, score as written; netsets.operators.evidence.clean makes them canonical."""
    f = _fields(F.col(LINE), r"\t")
    get = lambda i: F.try_element_at(f, F.lit(i + 1))
    return lines(spark, path).select(get(0).alias("u"), get(1).alias("v"), get(2).alias("subtype"), F.nullif(get(3), F.lit("")).cast("double").alias("score"))


def read_cross_validation(spark: SparkSession, path: str) -> DataFrame:
    """iteration, cid: lines `iter N`, each followed by the ids that it tests."""
    f = _fields(F.col(LINE))
    rows = under_headers(lines(spark, path), f[0] == "iter", f[1].cast("int"))
    return rows.select(F.col("head").alias("iteration"), F.col(LINE).alias("cid"))


def read_hubs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node, degree) and (u, v, w) of a file with the sections `hubs` and `edges`."""
    f = _fields(F.col(LINE))
    rows = under_headers(lines(spark, path), F.col(LINE).isin("hubs", "edges"), F.col(LINE))
    hubs = rows.where("head = 'hubs'").select(f[0].alias("node"), f[1].cast("long").alias("degree"))
    ends = F.split(f[0], r"\|")
    return hubs, rows.where("head = 'edges'").select(ends[0].alias("u"), ends[1].alias("v"), f[1].cast("double").alias("w"))


def hub_lines(hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """value, part, at: lines of the two sections in order."""
    a = hubs.select(F.concat_ws("\t", "node", "degree").alias("value"), F.lit(1).alias("part"))
    b = edges.select(F.concat_ws("\t", F.concat_ws("|", "u", "v"), "w").alias("value"), F.lit(3).alias("part"))
    heads = hubs.sparkSession.createDataFrame([("hubs", 0), ("edges", 2)], "value string, part int")
    return heads.unionByName(a).unionByName(b).orderBy("part", "value")


def read_line_clusters(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """cid, node of programs that print a set a line between tabs or spaces; sets under `least` members go."""
    return read_sets(spark, path, least=least)


def read_block_clusters(spark: SparkSession, path: str, header: str = r"^Complex\b", skip: str = r"^(Core|Attachments?)\b:?", least: int = 2) -> DataFrame:
    """cid, node of programs that print blocks: a header line, then members, perhaps behind words that name their part. Blocks are
    numbered from 1; members before the first header are set 0."""
    is_head = F.col(LINE).rlike(header)
    rows = lines(spark, path)
    blocks = numbered(rows.where(is_head)).select(F.col("at").alias("head_at"), F.col("n").cast("string").alias("cid"))
    kept = under_headers(rows, is_head, F.col(LINE)).join(blocks, "head_at", "left").withColumn("cid", F.coalesce("cid", F.lit("0")))
    members = kept.select("cid", F.explode(_fields(F.regexp_replace(LINE, skip, ""))).alias("node")).where("node <> ''").distinct()
    size = members.groupBy("cid").count().where(F.col("count") >= least).select("cid")
    return members.join(size, "cid", "left_semi")


def strip_names(rows: DataFrame) -> DataFrame:
    """value: scored set lines from their bracket on."""
    return rows.select(F.regexp_replace(LINE, r"^[^(]*\(", "(").alias("value"))


def write_arff(wide: DataFrame, path: str, relation: str, numeric: list[str], cls: str) -> None:
    """Attribute table for learners: header lines, then a row per edge."""
    spark = wide.sparkSession
    values = ",".join(str(r[0]) for r in wide.select(cls).distinct().orderBy(cls).collect())
    head = [f"@relation {relation}", *[f"@attribute {c} numeric" for c in numeric], f"@attribute {cls} {{{values}}}", "@data"]
    body = wide.select(F.concat_ws(",", *numeric, cls).alias("value"), F.lit(1).alias("part"))
    top = spark.createDataFrame([(h, 0, i) for i, h in enumerate(head)], "value string, part int, n int")
    both = top.unionByName(body.withColumn("n", F.lit(0)))
    both.orderBy("part", "n", "value").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated with a header: likelihood tables, class scores, curves."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
