"""Sequence functions as column expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.schemas import REV

# The IUPAC codes of ambiguous bases.
AMBIGUOUS = "RYSWKMBDHVNU"


def reverse_complement(seq: str) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def packed_letters(seq: str) -> Column:
    """What two bits a base keep of a sequence: A-Z upper case, ambiguous codes and gaps as A."""
    return F.translate(F.translate(seq, ascii_lowercase, ascii_uppercase), AMBIGUOUS + "-", "A" * (len(AMBIGUOUS) + 1))


def ambiguity_runs(seq: str, merged: bool = False) -> Column:
    """Runs of one ambiguous code; merged: runs of any."""
    pattern = f"[{AMBIGUOUS}]+" if merged else "|".join(f"{c}+" for c in AMBIGUOUS)
    return F.regexp_extract_all(F.upper(seq), F.lit(f"({pattern})"), 1)


def sub_read(seq: str, start: str, end: str, strand: str) -> Column:
    """Bases of [start, end) in the frame of the strand."""
    n = F.col(end) - F.col(start)
    forward = F.substring(F.col(seq), F.col(start).cast("int") + 1, n.cast("int"))
    return F.when(F.col(strand) == REV, F.substring(reverse_complement(seq), F.col(start).cast("int") + 1, n.cast("int"))).otherwise(forward)


def long_enough(seq: str, bases: int) -> Column:
    return F.length(seq) >= bases


def flip(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """An interval seen from the other strand."""
    return size - end, size - start


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, the first base highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def split_reads(reads: DataFrame, length: int, overlap: int, least_last: int, name: str = "name", seq: str = "seq") -> DataFrame:
    """Cut long reads to chunks of ``length``, each beginning ``overlap`` before the end of the last.

    A rest under ``least_last`` stays with the last chunk. Reads of one chunk keep their name, others get
    name_from_to. Closed form, so a read's chunks are exploded without a loop.
    """
    n, least = F.length(seq), max(least_last, 1)
    chunks = F.greatest(F.lit(1), F.ceil((n - length - least + 1) / (length - overlap)) + 1)
    cut = reads.where(n > 0).withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.withColumn("from", F.col("chunk") * (length - overlap)).withColumn("to", F.when(F.col("chunk") == F.col("chunks") - 1, n).otherwise(F.col("from") + length))
    label = F.when(F.col("chunks") == 1, F.col(name)).otherwise(F.concat_ws("_", name, "from", "to"))
    return cut.select(label.alias("name"), F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"), F.substring(F.col(seq), F.col("from").cast("int") + 1, (F.col("to") - F.col("from")).cast("int")).alias("seq"))


def split_header(header: Column) -> tuple[Column, Column]:
    """Name and comment of a record's header line."""
    h = F.ltrim(header)
    return F.regexp_extract(h, r"^(\S+)", 1), F.ltrim(F.regexp_extract(h, r"^\S+\s*(.*)$", 1))


def plausible_bases(line: Column) -> Column:
    """Is the first data line of a record like a sequence? At most 70 characters are looked at."""
    head = F.substring(line, 1, 70)
    good = F.length(F.regexp_replace(head, r"[^A-Za-z*\-]", ""))
    bad = F.length(head) - good - F.length(F.regexp_replace(head, r"[^\s0-9]", ""))
    return ~((bad >= F.floor(good / 3)) & ((F.length(head) > 3) | (good == 0) | (bad > good)))


def group_name(name: Column, qdir: Column, sid: Column, gid: Column, sfrom: Column, sto: Column) -> Column:
    return F.concat(name, F.lit("_svr:"), F.concat_ws(":", *(c.cast("string") for c in (qdir, sid, gid, sfrom, sto))))


def parse_group_name(text: Column) -> list[Column]:
    """name, qdir, sid, gid, sfrom, sto; the last ``_svr:`` counts."""
    pattern = r"^(.*)_svr:(\d+):(\d+):(\d+):(\d+):(\d+)$"
    return [F.regexp_extract(text, pattern, 1)] + [F.regexp_extract(text, pattern, i).cast("long") for i in range(2, 7)]


def consensus_name(name: Column, *numbers: Column) -> Column:
    return F.concat(name, F.lit("_cns:"), F.concat_ws(":", *(c.cast("string") for c in numbers)))


def parse_consensus_name(text: Column, n: int = 6) -> list[Column]:
    pattern = r"^(.*)_cns:" + ":".join([r"(\d+)"] * n) + "$"
    return [F.regexp_extract(text, pattern, 1)] + [F.regexp_extract(text, pattern, i).cast("long") for i in range(2, n + 2)]
