"""SAM text: alignment records, header and contig dictionary, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haplospark.operators import realign

#: Columns of records, of SAM and BAM alike. mate_tid, mate_pos (from 0) and tlen are of the mate; tags have their type in front, as Z:text.
SCHEMA = "qname string, flag int, tid int, pos int, mapq int, cigar string, seq string, qual string, mate_tid int, mate_pos int, tlen int, xg string, op int, oc string, tags map<string,string>"
_HEADER = "^@[A-Z][A-Z](\t|$)"


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines in order, each once: files of a directory may all have it. They are as many as contigs and read groups."""
    lines = spark.read.text(path).where(F.col("value").rlike(_HEADER)).withColumn("at", F.monotonically_increasing_id())
    return [r.value for r in lines.groupBy("value").agg(F.min("at").alias("at")).orderBy("at").collect()]


def contigs_of(lines: list[str]) -> list[tuple[str, int]]:
    """Names and lengths of the contigs of a header."""
    fields = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x) for line in lines if line.startswith("@SQ\t")]
    return [(f["SN"], int(f.get("LN", 0))) for f in fields]


def header_of(contigs: DataFrame) -> list[str]:
    """A header for contigs(tid, name, length or seq)."""
    length = F.col("length") if "length" in contigs.columns else F.length("seq")
    rows = contigs.select("tid", "name", length.alias("length")).orderBy("tid").collect()
    return ["@HD\tVN:1.6\tSO:coordinate", *(f"@SQ\tSN:{r.name}\tLN:{r.length}" for r in rows)]


def sorted_header(lines: list[str]) -> list[str]:
    """The header with the order that a sorted file has."""
    fields = [x for x in lines[0].split("\t") if not x.startswith(("SO:", "GO:"))] if lines and lines[0].startswith("@HD") else ["@HD", "VN:1.6"]
    return ["\t".join([*fields, "SO:coordinate"]), *(x for x in lines if not x.startswith("@HD"))]


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """tid (order in the header), name, length."""
    lines = spark.read.text(path).where("value like '@SQ\t%'").withColumn("at", F.monotonically_increasing_id())
    lines = lines.groupBy("value").agg(F.min("at").alias("at"))
    name, length = F.regexp_extract("value", r"\tSN:([^\t]+)", 1), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("int")
    # A row for each contig of the header.
    tid = F.row_number().over(Window.orderBy("at")) - 1
    return lines.select(tid.cast("int").alias("tid"), name.alias("name"), length.alias("length"))


def _tag_map(fields: Column) -> Column:
    """name -> type:value; of a repeated tag the first one stays."""
    entries = F.transform(F.slice(fields, F.lit(12), F.greatest(F.size(fields) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.substring(t, 4, 1 << 30).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))


def read(spark: SparkSession, path: str, contigs: DataFrame | None = None) -> DataFrame:
    """The columns of SCHEMA; what is * or 0 there is null here. Header lines and empty ones go; a line of fewer than 11 fields is an error."""
    contigs = contigs if contigs is not None else read_contigs(spark, path)
    # What isn't a record has no fields, wherever Spark puts the filter that leaves it out.
    record = (F.col("value") != "") & ~F.col("value").rlike(_HEADER)
    f = F.when(record, F.split("value", "\t"))
    short = F.raise_error(F.concat(F.lit("a SAM line has fewer than 11 fields: "), F.substring("value", 1, 80)))
    at = lambda i: F.get(F.col("f"), F.lit(i))
    number = lambda i: F.expr(f"try_cast(get(f, {i}) as int)")
    lines = spark.read.text(path).where(record).select(F.when(F.size(f) < 11, short.cast("array<string>")).otherwise(f).alias("f"))
    rows = lines.select(
        F.when(at(0) != "*", at(0)).alias("qname"), number(1).alias("flag"), at(2).alias("name"), (number(3) - 1).alias("pos"), number(4).alias("mapq"),
        *(F.when(at(i) != "*", at(i)).alias(c) for i, c in ((5, "cigar"), (9, "seq"), (10, "qual"))),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_name"), (number(7) - 1).alias("mate_pos"), number(8).alias("tlen"), _tag_map(F.col("f")).alias("all_tags"),
    )
    names = contigs.select("tid", "name")
    joined = rows.join(names, "name", "left").join(names.selectExpr("tid as mate_tid", "name as mate_name"), "mate_name", "left")
    tag = lambda k: F.substring(F.col("all_tags")[k], 3, 1 << 30)
    place = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return joined.select(
        "qname", "flag", "tid", place("pos"), "mapq", "cigar", "seq", "qual", "mate_tid", place("mate_pos"), "tlen",
        tag("XG").alias("xg"), F.expr("try_cast(substring(all_tags['OP'], 3) as int)").alias("op"), tag("OC").alias("oc"), F.map_filter("all_tags", lambda k, _: ~k.isin("XG", "OP", "OC")).alias("tags"),
    )


def lines(reads: DataFrame, contigs: DataFrame, header: list[str] | None = None) -> DataFrame:
    """value: the header (made from contigs if none is given), and the records in coordinate order."""
    spark = reads.sparkSession
    have = lambda c, kind: F.col(c) if c in reads.columns else F.lit(None).cast(kind)
    star = lambda c: F.coalesce(have(c, "string"), F.lit("*"))
    place = lambda c: (F.coalesce(have(c, "int"), F.lit(-1)) + 1).cast("string")
    names = contigs.select("tid", "name")
    named = reads.join(names, "tid", "left")
    if "mate_tid" in reads.columns:
        named = named.join(names.selectExpr("tid as mate_tid", "name as mate_name"), "mate_tid", "left")
        mate = F.when(F.col("mate_tid") == F.col("tid"), "=").otherwise(F.coalesce("mate_name", F.lit("*")))
    else:
        mate = F.lit("*")
    tags = F.transform(F.map_entries(have("tags", "map<string,string>")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    text = F.concat_ws(
        "\t", star("qname"), F.coalesce("flag", F.lit(0)).cast("string"), F.coalesce("name", F.lit("*")), place("pos"), F.coalesce("mapq", F.lit(0)).cast("string"),
        star("cigar"), mate, place("mate_pos"), F.coalesce(have("tlen", "int"), F.lit(0)).cast("string"), star("seq"), star("qual"),
        F.concat(F.lit("XG:Z:"), have("xg", "string")), F.concat(F.lit("OP:i:"), have("op", "int").cast("string")), F.concat(F.lit("OC:Z:"), have("oc", "string")), F.array_join(tags, "\t"),
    )
    body = named.select(F.lit(1).alias("part"), F.coalesce("tid", F.lit((1 << 31) - 1)).alias("at"), "pos", "qname", "flag", F.regexp_replace(text, "\t$", "").alias("value"))
    rows = [(0, i, 0, "", 0, x) for i, x in enumerate(header if header is not None else header_of(contigs))]
    head = spark.createDataFrame(rows, "part int, at int, pos int, qname string, flag int, value string")
    return head.unionByName(body).orderBy("part", "at", "pos", "qname", "flag").select("value")


def write(reads: DataFrame, contigs: DataFrame, path: str, header: list[str] | None = None) -> None:
    lines(reads, contigs, header).write.mode("overwrite").text(path)


def write_parquet(reads: DataFrame, path: str) -> None:
    """Parquet by contig, sorted inside, so that statistics of pos serve as an index."""
    realign.coordinate_sorted(reads).drop("endpos").write.mode("overwrite").partitionBy("tid").parquet(path)
