"""Sources, sinks and the incremental run."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import fasta, records
from readloom.streaming import incremental


def test_fasta(spark, tmp_path):
    f = tmp_path / "a.fa"
    f.write_text(">r1 first read\nACGT\nAC;gone\n# note\nGT\n>r2\nNNN\n>r3\n12345\n")
    assert fasta.sniff(spark, str(f)) == "fasta"
    got = {r.name: (r.comment, r.seq) for r in fasta.read_fasta(spark, str(f)).collect()}
    assert got == {"r1": ("first read", "ACGTACGT"), "r2": ("", "NNN")}
    fasta.write_fasta(fasta.read_fasta(spark, str(f)), str(tmp_path / "out"))
    assert fasta.read_fasta(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "list").write_text(f"{f}\n")
    assert fasta.sniff(spark, str(tmp_path / "list")) == "list" and fasta.read_listed(spark, str(tmp_path / "list")).count() == 2


def test_fastq(spark, tmp_path):
    good = "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n@@\n"
    (tmp_path / "a.fq").write_text(good)
    want = {("r1", "x", "ACGT", "IIII"), ("r2", "", "AC", "@@")}
    for mode in ("DROPMALFORMED", "FAILFAST"):
        assert {tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "a.fq"), mode).collect()} == want
    (tmp_path / "b.fq").write_text("@r0\nACG\n+\nII\nnoise\n" + good + "@r3\nAC\n")
    assert {tuple(r) for r in fasta.read_fastq(spark, str(tmp_path / "b.fq")).collect()} == want
    with pytest.raises(Exception, match="malformed"):
        fasta.read_fastq(spark, str(tmp_path / "b.fq"), "FAILFAST").collect()


def test_fastq_of_several_blocks(spark, tmp_path):
    """A file is cut anywhere, also within records."""
    rows = [(f"r{i}", "ACGT" * (1 + i % 9), "I@+#" * (1 + i % 9)) for i in range(3000)]
    (tmp_path / "c.fq").write_text("".join(f"@{n}\n{s}\n+\n{q}\n" for n, s, q in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "c.fq")).rdd.getNumPartitions() > 5
        assert sorted((r.name, r.seq, r.qual) for r in fasta.read_fastq(spark, str(tmp_path / "c.fq"), "FAILFAST").collect()) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def plain_records(text):
    """Records of mixed FASTA and FASTQ, one line after the other."""
    lines = [x for x in (y.rstrip() for y in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if x]
    out, i, now = [], 0, None
    while i < len(lines):
        x = lines[i]
        if x[0] == "@" and x[1:2].strip() and i + 3 < len(lines) and lines[i + 2][0] == "+" and len(lines[i + 1]) == len(lines[i + 3]) and lines[i + 1][0] != "+":
            out.append([x[1:], [lines[i + 1]], lines[i + 3]])
            now, i = None, i + 4
            continue
        if x[0] == ">":
            now = [x[1:], [], None]
            out.append(now)
        elif now is not None and x[0] not in "!#;":
            now[1].append("".join(x.split(";")[0].split()))
        i += 1
    split = lambda h: (h.split(None, 1) + ["", ""])[:2]
    return sorted((*split(h), "".join(s).upper(), q or "") for h, s, q in out if split(h)[0])


def test_mixed(spark, tmp_path, monkeypatch):
    """FASTA and FASTQ in one file, all line ends, cut anywhere; the same records for every cut."""
    rng = random.Random(2)
    bases = lambda n: "".join(rng.choices("acgtN", k=n))
    parts = ["noise before\n", "; a comment\n"]
    for i in range(400):
        if rng.random() < 0.5:
            body = "".join(bases(rng.randrange(1, 30)) + rng.choice(["", "", ";gone", "  "]) + "\n" + rng.choice(["", "", "\n", "# no >data\n", "   \n"]) for _ in range(rng.randrange(5)))
            parts.append(f">f{i}{rng.choice(['', ' of fasta > @'])}\n{body}")
        else:
            n = rng.randrange(1, 20)
            parts.append(f"@q{i}{rng.choice(['', ' x'])}\n{bases(n)}\n+\n{''.join(rng.choices('@>+I#;', k=n))}\n{rng.choice(['', '', 'stray' + chr(10)])}")
    for k, end in enumerate(("\n", "\r\n", "\r")):
        text = "".join(parts).replace("\n", end)
        (tmp_path / f"{k}.txt").write_bytes(text.encode())
        for stretch, size in ((1 << 16, "128m"), (7, "700")):
            monkeypatch.setattr(fasta, "STRETCH", stretch)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = sorted((r.name, r.comment, r.seq, r.qual or "") for r in fasta.read_mixed(spark, str(tmp_path / f"{k}.txt")).collect())
            assert got == plain_records(text)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "bad.txt").write_text("> \nACGT\n>r\n12345\n>ok\nAC\n>empty\n")
    assert sorted((r.name, r.seq) for r in fasta.read_mixed(spark, str(tmp_path / "bad.txt")).collect()) == [("empty", ""), ("ok", "AC")]
    (tmp_path / "old.fa").write_bytes(b">a x\rAC\rGT\r")
    assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "old.fa")).collect()] == [("a", "x", "ACGT")]


def test_groups_and_masks(spark, tmp_path):
    d = spark.createDataFrame([(0, 6, 3, 0, 11, 5, 50), (0, 6, 3, 1, 12, 6, 51), (0, 0, 4, 0, 13, 9, 70)], "sid long, type int, group_id long, member int, qid long, sfrom long, len long")
    records.group_lines(d).write.text(str(tmp_path / "g"))
    got = records.read_groups(spark, str(tmp_path / "g")).collect()
    assert sorted((r.sid, r.type, r.group_id, r.member, r.qid, r.sfrom, r.len) for r in got) == sorted(map(tuple, d.collect()))
    with pytest.raises(Exception, match="missing"):
        records.parse_groups(spark.createDataFrame([(">\t7\t2\n1\t0\t6\t5\t50",)], "value string")).collect()
    (tmp_path / "m.bed").write_text("a\t5\t9\na\t9\t9\nb\t0\t4\n")
    subjects = spark.createDataFrame([("a", 9)], "name string, size long")
    assert [tuple(r) for r in records.read_mask(spark, str(tmp_path / "m.bed"), subjects).collect()] == [("a", 5, 9)]
    with pytest.raises(Exception, match="beyond"):
        records.read_mask(spark, str(tmp_path / "m.bed"), subjects.withColumn("size", F.lit(8))).collect()


def test_records(spark, tmp_path):
    row = ("q", "s", 91.5, 8, 1, 10, 90, 100, 0, 5, 85, 200)
    (tmp_path / "a.m4").write_text("\t".join(map(str, row)) + "\n")
    d = records.read_m4(spark, str(tmp_path / "a.m4"))
    assert tuple(d.first()) == row and records.m4_lines(d).first().value == "q\ts\t91.50\t8\t1\t10\t90\t100\t0\t5\t85\t200"
    full = d.selectExpr("*", "70 as matches", "80 as columns", "'80M' as cigar", "'ACGT' as seq")
    assert records.paf_lines(full, True).first().value.split("\t")[4:6] == ["-", "s"]
    assert records.sam_lines(full).first().value.split("\t")[:6] == ["q", "16", "s", "6", "60", "10S80M10S"]
    assert records.sam_header(d.select("sname", "ssize")).count() == 3


def test_incremental(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(src)
        incremental.process_new(spark, src, "id long", lambda b: b.groupBy().count(), out, check).awaitTermination()
    assert sorted(r["count"] for r in spark.read.parquet(out).collect()) == [3, 5]
