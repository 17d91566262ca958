"""FASTA and FASTQ sources and sinks, gzip included.

Records are found in text lines by Spark: lines of a file are read in order with their offsets, a header line opens
a record, and the lines up to the next header are joined. Nothing is read on the driver but, for ``sniff``, one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.sequence import plausible_bases, split_header


def sniff(spark: SparkSession, path: str) -> str:
    """fasta, fastq, list (of paths) or empty, by the first line that isn't blank or a comment."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^[!#;]") & (F.length(F.trim("value")) > 0)).take(1)
    if not lines:
        return "empty"
    return {">": "fasta", "@": "fastq"}.get(lines[0].value.lstrip()[0], "list")


def read_fasta(spark: SparkSession, paths: str | list[str], mode: str = "DROPMALFORMED") -> DataFrame:
    """Records: name, comment, seq. Split at header marks by the text source, so a file's records are read in parallel.

    Lines that begin with !, # or ; are left out, and a ; ends a line. mode: DROPMALFORMED leaves out records without
    a name or with a first line unlike a sequence, FAILFAST raises for them.
    """
    parts = spark.read.text(paths, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"^\s*>", "")
    head = F.substring_index(body, "\n", 1)
    rest = F.when(F.instr(body, "\n") > 0, F.expr("1")).isNotNull()
    lines = F.when(rest, F.substring(body, F.instr(body, "\n") + 1, F.length(body))).otherwise("")
    data = F.regexp_replace(F.regexp_replace(lines, r"(?m)^[!#;].*$", ""), r"(?m);.*$", "")
    name, comment = split_header(head)
    rows = parts.select(name.alias("name"), comment.alias("comment"), F.substring_index(F.ltrim(data), "\n", 1).alias("_first"), F.upper(F.regexp_replace(data, r"\s", "")).alias("seq"))
    good = (F.length("name") > 0) & ((F.length("_first") == 0) | plausible_bases(F.col("_first")))
    if mode == "FAILFAST":
        rows = rows.withColumn("name", F.when(good, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("malformed record "), "name"))))
    else:
        rows = rows.where(good)
    return rows.select("name", "comment", "seq")


def _numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines that aren't blank, without white space at their ends: file, n (from 0 in the file), value. Blocks of a file are read in parallel; a block's
    lines are numbered on their own, and the blocks' counts, one row each, tell where each begins."""
    lines = spark.read.text(paths).select(F.regexp_replace("value", r"\s+$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i")).where(F.length("value") > 0)
    own = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_i")) - 1
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "_block").agg(F.count("*").alias("_k")).select("file", "_block", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_first"))
    return lines.withColumn("_own", own).join(blocks, ["file", "_block"]).select("file", (F.col("_first") + F.col("_own")).alias("n"), "value")


#: Lines of a file that one task orders.
STRETCH = 1 << 16


def _marked_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Numbered lines with the three that follow (_l1 to _l3), whether a FASTQ record starts there, or the line is in one.

    Files are cut into stretches of lines (_g), with three lines of either neighbour.
    """
    stretch, more = STRETCH, 3
    n = F.col("n")
    lines = _numbered_lines(spark, paths).withColumn("_g", F.floor(n / stretch))
    near = F.array(F.col("_g"), F.when(n % stretch < more, F.col("_g") - 1), F.when(n % stretch >= stretch - more, F.col("_g") + 1))
    w = Window.partitionBy("file", "_part").orderBy("n")
    d = lines.withColumn("_part", F.explode(F.array_compact(near)))
    d = d.withColumns({f"_l{k}": F.lead("value", k).over(w) for k in (1, 2, 3)})
    good = F.col("value").rlike(r"^@\S") & F.col("_l2").startswith("+") & (F.length("_l1") == F.length("_l3")) & ~F.col("_l1").startswith("+")
    d = d.withColumn("_start", F.coalesce(good, F.lit(False)))
    return d.withColumn("_inside", F.max("_start").over(w.rowsBetween(-more, 0))).where("_part = _g")


def read_fastq(spark: SparkSession, paths: str | list[str], mode: str = "DROPMALFORMED") -> DataFrame:
    """Records of four lines: name, comment, seq, qual.

    A record is a line that begins with @ and a name, a line of bases, one that begins with + and one as long as the
    bases'. mode: DROPMALFORMED leaves out lines that are part of no record, so reading goes on at the next one;
    FAILFAST raises for them.
    """
    d, n = _marked_lines(spark, paths), F.col("n")
    name, comment = split_header(F.substring("value", 2, 1 << 30))
    if mode == "FAILFAST":
        name = F.when(F.col("_start"), name).otherwise(F.raise_error(F.concat(F.lit("malformed line "), n.cast("string"))))
        d = d.where("_start or not _inside")
    else:
        d = d.where("_start")
    return d.select(name.alias("name"), comment.alias("comment"), F.upper("_l1").alias("seq"), F.col("_l3").alias("qual"))


def read_mixed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of files that hold FASTA and FASTQ in any order: name, comment, seq, qual (null for FASTA).

    Lines end with a line feed, a carriage return or both. FASTQ records are those of ``read_fastq``. Of the other
    lines, one that begins with > opens a FASTA record, and the lines behind it belong to it up to the next record of
    either kind; those that begin with !, # or ; are left out, and a ; ends a line. Lines that no record owns, records
    without a name and those with a first line unlike a sequence are left out. Each stretch of lines finds its owners
    on its own; a stretch's last record, one row each, is what the next ones begin in. A record's lines are joined in
    one task, as the record is one row.
    """
    d = _marked_lines(spark, paths)
    head, text = F.col("value").startswith(">"), F.col("value")
    opens = F.when(F.col("_start") | (~F.col("_inside") & head), F.col("n"))
    d = d.withColumn("_own", F.max(opens).over(Window.partitionBy("file", "_g").orderBy("n")))
    carried = F.max("_last").over(Window.partitionBy("file").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    before = d.groupBy("file", "_g").agg(F.max("_own").alias("_last")).select("file", "_g", carried.alias("_before"))
    d = d.join(before, ["file", "_g"]).withColumn("_own", F.coalesce("_own", "_before")).where("_own is not null")
    # of a FASTQ record only its first line is needed; lines behind it that are in no record have it as owner, and go
    d = d.where(F.col("_start") | ~F.col("_inside"))
    data = F.when(head | text.rlike("^[!#;]") | F.col("_start"), None).otherwise(F.struct("n", F.regexp_replace(F.substring_index(text, ";", 1), r"\s", "").alias("x")))
    first = lambda c: F.max(F.when(F.col("n") == F.col("_own"), c))
    lines = d.groupBy("file", "_own").agg(first(text).alias("_head"), first(F.col("_l1")).alias("_l1"), first(F.col("_l3")).alias("qual"), first(F.col("_start")).alias("_fastq"), F.array_sort(F.collect_list(data)).alias("_lines"))
    name, comment = split_header(F.substring("_head", 2, 1 << 30))
    seq = F.when(F.col("_fastq"), F.col("_l1")).otherwise(F.array_join("_lines.x", ""))
    good = F.col("_fastq") | (F.size("_lines") == 0) | plausible_bases(F.col("_lines")[0].x)
    rows = lines.select(name.alias("name"), comment.alias("comment"), F.upper(seq).alias("seq"), F.when(F.col("_fastq"), F.col("qual")).alias("qual"), good.alias("_good"))
    return rows.where((F.length("name") > 0) & F.col("_good")).drop("_good")


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """A file of paths, one a line: their records, FASTA or FASTQ. The list is as long as the number of files."""
    return read_mixed(spark, [r.value.strip() for r in spark.read.text(path).where(F.length(F.trim("value")) > 0).collect()])


def fasta_lines(rows: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    fasta_lines(rows, name, seq).write.mode("overwrite").text(path)
