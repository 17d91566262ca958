"""Text sources and sinks of alignments, masks, SV reads, signatures: M4, BED, PAF, SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators.intervals import running


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, mode="DROPMALFORMED")


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of tab-separated lines (value); lines that don't fit the schema are left out."""
    row = F.from_csv("value", schema + ", _bad string", {"sep": "\t", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(row.alias("r")).where("r._bad is null").select("r.*").drop("_bad")


def read_m4(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.ALIGNMENT)


def read_mask(spark: SparkSession, path: str, subjects: DataFrame | None = None) -> DataFrame:
    """Intervals of three columns; empty and reversed ones are left out.

    With ``subjects`` (name, size) those of unknown subjects are left out, and one that ends beyond its subject is an
    error.
    """
    rows = _read(spark, path, schemas.MASK).where("`from` < `to` and `from` >= 0")
    if subjects is None:
        return rows
    beyond = F.when(F.col("to") > F.col("_size"), F.raise_error(F.concat(F.lit("interval beyond the end of "), "name"))).otherwise(F.col("to"))
    return rows.join(subjects.select("name", F.col("size").alias("_size")), "name").withColumn("to", beyond).drop("_size")


def read_sv_reads(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, schemas.SV_READ)


def read_signatures(spark: SparkSession, path: str, kind: int | None = None) -> DataFrame:
    rows = _read(spark, path, schemas.SIGNATURE)
    return rows if kind is None else rows.where(F.col("type") == kind)


def with_ids(rows: DataFrame, names: DataFrame, column: str, to: str, missing: str = "drop") -> DataFrame:
    """Names replaced by ids (names: name, id). missing: drop rows without one, or fail."""
    ids = names.select(F.col("name").alias(column), F.col("id").alias(to))
    if missing == "drop":
        return rows.join(ids, column)
    return rows.join(ids, column, "left").withColumn(to, F.when(F.col(to).isNull(), F.raise_error(F.concat(F.lit("no id of "), column))).otherwise(F.col(to)))


def remapped(rows: DataFrame, names: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Several columns of names replaced by ids (columns: name column -> id column); rows lacking one are dropped."""
    for column, to in columns.items():
        rows = with_ids(rows, names, column, to).drop(column)
    return rows


def only(rows: DataFrame, ids: DataFrame, column: str = "rid", keep: bool = True) -> DataFrame:
    """Rows whose id is (or, if not ``keep``, isn't) among the first column of ``ids``."""
    asked = ids.select(F.col(ids.columns[0]).alias(column))
    return rows.join(asked, column, "left_semi" if keep else "left_anti")


def renamed(rows: DataFrame, key: str, width: int = 10) -> DataFrame:
    """Add ``name``: the row's place in the order of ``key`` (a unique whole number), from 0, padded with zeros."""
    ones = rows.withColumn("_one", F.lit(1))
    return running(ones, [], [key], {"_nth": ("_one", "sum", False)}, 1 << 14).withColumn("name", F.lpad(F.col("_nth").cast("string"), width, "0")).drop("_one", "_nth")


def _lines(rows: DataFrame, *columns: Column) -> DataFrame:
    return rows.select(F.concat_ws("\t", *(c.cast("string") for c in columns)).alias("value"))


def m4_lines(rows: DataFrame, cigar: bool = False, md: bool = False) -> DataFrame:
    """Lines of an alignment each; with the columns ``cigar`` and ``md`` behind them."""
    order = "qname sname ident score qdir qoff qend qsize sdir soff send ssize".split()
    more = [F.col(c) for c, wanted in (("cigar", cigar), ("md", md)) if wanted]
    return _lines(rows, *(F.format_string("%.2f", F.col(c).cast("double")) if c == "ident" else F.col(c) for c in order), *more)


def candidate_lines(rows: DataFrame, windows: bool = False) -> DataFrame:
    """Lines of candidates: qid, sid, score; or, for windows, qid, qdir, sid, from, to, score."""
    order = "qid qdir sid from to score" if windows else "qid sid score"
    return _lines(rows, *(F.col(c) for c in order.split()))


def _measures(md: bool) -> list[Column]:
    """Tags of the chain's score, mismatches and gaps, the alignment's score, and the MD string."""
    tags = [F.concat(F.lit("s1:i:"), F.col("score").cast("string")), F.concat(F.lit("NM:i:"), (F.col("columns") - F.col("matches")).cast("string")), F.concat(F.lit("AS:i:"), F.col("score").cast("string"))]
    return tags + ([F.concat(F.lit("MD:Z:"), F.col("md"))] if md else [])


def paf_lines(rows: DataFrame, cigar: bool = False, md: bool = False) -> DataFrame:
    """Twelve columns and the tags; mapping quality is always 60. Needs matches and columns (aligned)."""
    strand = F.when(F.col("qdir") == schemas.REV, "-").otherwise("+")
    tags = _measures(md)
    if cigar:
        tags.insert(3, F.concat(F.lit("cg:Z:"), F.col("cigar")))
    return _lines(rows, *(F.col(c) for c in ("qname", "qsize", "qoff", "qend")), strand, *(F.col(c) for c in ("sname", "ssize", "soff", "send", "matches", "columns")), F.lit(60), *tags)


def sam_lines(rows: DataFrame, group: str | None = None, md: bool = False, places: bool = False) -> DataFrame:
    """One SAM line a row: flag 16 if reversed, 1-based place, quality 60, soft clips around the CIGAR, the tags.

    places: also the query's places and size, and both identities (columns ident and eff).
    """
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    whole = F.concat(clip(F.col("qoff")), F.col("cigar"), clip(F.col("qsize") - F.col("qend")))
    tags = _measures(md) + ([F.lit(f"RG:Z:{group}")] if group else [])
    if places:
        tags += [F.concat(F.lit(f"{t}:i:"), F.col(c).cast("string")) for t, c in (("qs", "qoff"), ("qe", "qend"), ("ql", "qsize"))]
        tags += [F.concat(F.lit(f"{t}:f:"), F.regexp_replace(F.regexp_replace(F.format_string("%.4f", F.col(c).cast("double")), r"0+$", ""), r"\.$", "")) for t, c in (("mc", "ident"), ("ec", "eff"))]
    return _lines(rows, F.col("qname"), F.when(F.col("qdir") == schemas.REV, 16).otherwise(0), F.col("sname"), F.col("soff") + 1, F.lit(60), whole, F.lit("*"), F.lit("*"), F.lit(0), F.col("seq"), F.lit("*"), *tags)


def sam_header(subjects: DataFrame, program: str = "readloom", group: str | None = None, sample: str | None = None) -> DataFrame:
    """Header lines of subjects (sname, ssize), with their order in ``nth``."""
    spark = subjects.sparkSession
    read_group = "@RG" + (f"\tID:{group}" if group else "") + (f"\tSM:{sample or group}" if sample or group else "")
    fixed = [(0, "@HD\tVN:1.6\tSO:unknown\tGO:query"), (2, f"@PG\tID:{program}\tPN:{program}")] + ([(3, read_group)] if group or sample else [])
    named = subjects.select(F.lit(1).alias("nth"), F.format_string("@SQ\tSN:%s\tLN:%d", "sname", "ssize").alias("value"))
    return spark.createDataFrame(fixed, "nth int, value string").union(named)


GROUP = "qid long, sid long, type int, sfrom long, len long"


def group_lines(groups: DataFrame) -> DataFrame:
    """A text a group (value): a line with its id and number of members, then a line a member, in order of ``member``.

    groups: sid, type, group_id, member, qid, sfrom, len. A group's members stand together, so they make one row.
    """
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("qid", "sid", "type", "sfrom", "len")))
    whole = groups.groupBy("sid", "group_id").agg(F.sort_array(F.collect_list(F.struct("member", line.alias("l")))).alias("m"))
    head = F.concat_ws("\t", F.lit(">"), F.col("group_id").cast("string"), F.size("m").cast("string"))
    return whole.select(F.concat_ws("\n", head, F.array_join(F.transform("m", lambda x: x.l), "\n")).alias("value"))


def parse_groups(texts: DataFrame) -> DataFrame:
    """Members of ``group_lines``' texts: group_id, member (place in the group), qid, sid, type, sfrom, len.

    A group with another number of members than its first line says is an error.
    """
    d = texts.select(F.split(F.regexp_replace("value", r"^>?\s*|\s+$", ""), "\n").alias("l")).withColumn("h", F.split(F.col("l")[0], "\t"))
    d = d.select(F.col("h")[0].cast("long").alias("group_id"), F.col("h")[1].cast("int").alias("n"), F.expr("slice(l, 2, size(l))").alias("m"))
    right = F.when(F.col("n") == F.size("m"), F.col("m")).otherwise(F.raise_error(F.concat(F.lit("members are missing in group "), F.col("group_id").cast("string"))))
    each = d.select("group_id", F.posexplode(right).alias("member", "value"))
    return each.select("group_id", "member", F.from_csv("value", GROUP, {"sep": "\t"}).alias("r")).select("group_id", "member", "r.*")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return parse_groups(spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0))


def write_partitioned(rows: DataFrame, path: str, by: str, order: list[str]) -> None:
    """One folder a subject, rows in order within; a rerun replaces only the folders it writes."""
    out = rows.repartition(by).sortWithinPartitions(by, *order)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
