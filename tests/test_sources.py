"""Readers and writers on small text fixtures."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitelab.functions import stretches as S
from sitelab.operators.ordering import global_rank
from sitelab.sources import sinks as O
from sitelab.sources import text as T


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_short_pileup_row_is_an_error(spark):
    with pytest.raises(Exception, match="malformed pileup row"):
        T.parse_pileup(lines(spark, "chr1\t5\tC\t3"), [("a", "treated")]).collect()


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 'a "b"\tc', 0.1 + 0.2, True), (2, None, None, False), (3, "c", float("nan"), None), (4, "d", 1e-9, True), (5, "e", 123456789012345.0, True)],
        "i long, s string, x double, b boolean",
    )
    path = str(tmp_path / "t")
    O.write_tsv(df, path)
    got = {r.i: (r.s, r.x, r.b) for r in T.read_tsv(spark, path).collect()}
    assert got == {
        "1": ('a "b"\tc', "0.3", "1"), "2": (None, None, "0"), "3": ("c", None, None), "4": ("d", "1e-09", "1"), "5": ("e", "1.23456789012e+14", "1"),
    }
    with pytest.raises(Exception, match="(?i)exist"):
        O.write_tsv(df, path)


def test_carriage_returns_are_stripped(spark, tmp_path):
    (tmp_path / "x.tsv").write_bytes(b"a\tb\r\n1\tNA\r\n2\tz\r\n")
    assert [tuple(r) for r in T.read_tsv(spark, str(tmp_path / "x.tsv")).collect()] == [("1", None), ("2", "z")]


def test_reference_tiles_and_windows(spark, tmp_path):
    import random

    rng = random.Random(1)
    contigs = {"chr1": "".join(rng.choice("ACGT") for _ in range(1234)), "chr2": "".join(rng.choice("acgt") for _ in range(300))}
    text, index, offset = "", [], 0
    for name, seq in contigs.items():
        head = f">{name}\n"
        body = "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60))
        index.append(f"{name}\t{len(seq)}\t{offset + len(head)}\t60\t61")
        text += head + body
        offset += len(head) + len(body)
    (tmp_path / "r.fa").write_text(text)
    fai = T.parse_fasta_index(lines(spark, *index))
    tiles = T.reference_tiles(spark, str(tmp_path / "r.fa"), fai, tile=128, overlap=100)
    sites = spark.createDataFrame([(c, p) for c, s in contigs.items() for p in range(1, len(s) + 1, 7)], "chrom string, position long")
    for r in T.fetch_windows(sites, tiles, 50, 128).collect():
        seq = contigs[r.chrom].upper()
        want = seq[r.position - 51 : r.position + 50] if r.position > 50 and r.position + 50 <= len(seq) else None
        assert r.window == want


def test_overlapping_mates_count_once(spark):
    sam = lines(
        spark,
        "@HD\tVN:1.6",
        "q1\t99\tchr1\t10\t60\t5M\t=\t0\t0\tAACAA\tIIIII",
        "q1\t147\tchr1\t12\t60\t5M\t=\t0\t0\tTTTTT\t55555",
        "q2\t0\tchr1\t8\t60\t2M3D2M\t*\t0\t0\tGGGG\tIIII",
        "q3\t0\tchr1\t11\t60\t2S2M1I2M\t*\t0\t0\tAACCTGG\tIIIIIII",
        "q4\t1024\tchr1\t10\t60\t5M\t*\t0\t0\tAACAA\tIIIII",
        "q5\t0\tchr1\t10\t10\t5M\t*\t0\t0\tAACAA\tIIIII",
        "q6\t0\tchr1\t12\t60\t1M\t*\t0\t0\tT\t+",
    )
    sites = spark.createDataFrame([("chr1", 12)], "chrom string, position long")
    r = T.count_bases(sites, T.parse_sam(sam), extra=()).first()
    # q1 once by its better mate, q2 deleted here, q3 its second aligned base; the others are filtered.
    assert (r.C_forward, r.C_reverse, r.T_reverse, r.G_forward) == (2, 0, 0, 0)


def test_gtf_skips_other_lines(spark):
    text = lines(
        spark, "#c", "chr1\ts\texon\t11\t20\t.\t+\t.\tgene_id \"G1\"; transcript_id \"T1\"; gene_type \"x\";",
        "chr1\ts\tgene\t11\t20\t.\t+\t.\tgene_id \"G1\";", "chr1\ts\texon\t11\t20\t.\t.\t.\tgene_id \"G1\";", "chr1\ts\texon",
    )
    r = T.parse_gtf(text).collect()
    assert [(x.start0, x.end0, x.gene_id, x.gene_name, x.transcript_id, x.region_type) for x in r] == [(10, 20, "G1", "NA", "T1", "x")]


def test_annotation_header_and_rows(spark):
    text = lines(spark, "## x", "#Uploaded_variation\tGene", "REDI_chr1_5_C_T\tG1", "rs1\tG2")
    assert T.annotation_columns(text) == ["Uploaded_variation", "Gene"]
    assert [tuple(r) for r in T.parse_annotations(text, T.annotation_columns(text)).collect()] == [("chr1", 5, "C", "T", "G1")]


def test_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    files = O.file_digests(spark, str(tmp_path), "*.txt", chunk=2)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert got["a.txt"].sha256 == hashlib.sha256(b"one").hexdigest() and got["a.txt"].length == 3
    listed = spark.createDataFrame([(got["a.txt"].path, got["a.txt"].sha256), (got["b.txt"].path, "0"), ("c", "1")], "path string, sha256 string")
    states = {r.path.rsplit("/", 1)[-1]: r.state for r in O.verify_manifest(files, listed).collect()}
    assert states == {"a.txt": "match", "b.txt": "differs", "c": "missing"}


def test_pool_ids_are_dense(spark, tmp_path):
    df = spark.range(100).selectExpr("id as k", "id % 2 = 0 as matched", "id % 3 = 0 as hard").repartition(9)
    O.write_pool(df, str(tmp_path / "p"), ["k"])
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted(r.id for r in back.select("id").collect()) == list(range(1, 101))
    assert global_rank(df, ["k"]).filter("rank <> k + 1").count() == 0


def test_gate_publishes_only_what_holds(spark, tmp_path):
    import os

    from sitelab.sources.publish import Refused, publish, publish_pool

    df = spark.createDataFrame([(i, f"k{i}", "ACG", bool(i % 2)) for i in range(50)], "id long, key string, seq string, hard boolean").repartition(4)
    rules = {"long_enough": F.length("seq") < 3, "id_not_negative": F.col("id") < 0}
    path = str(tmp_path / "good")
    found = publish(df, path, rules, unique=["key"], required=["id", "seq"], expected=50, partition_by=["hard"])
    assert {r["assertion"]: r["status"] for r in found} == dict.fromkeys([*rules, "number_of_rows_as_expected", "key_is_unique"], "PASS")
    assert spark.read.parquet(path).count() == 50 and spark.read.json(f"{path}/_assertions").count() == 4
    with pytest.raises(FileExistsError):
        publish(df, path)
    broken = {
        "twice": (df.unionByName(df.limit(3)), {"unique": ["key"]}, [("key_is_unique", 3)]),
        "null key": (df.withColumn("key", F.when(F.col("id") > 1, F.col("key"))), {"unique": ["key"]}, [("key_is_unique", 2)]),
        "null": (df.withColumn("seq", F.when(F.col("id") > 0, F.col("seq"))), {"rules": rules}, [("long_enough", 1)]),
        "rows": (df, {"expected": 48}, [("number_of_rows_as_expected", 2)]),
        "suite": (df, {"suite": spark.createDataFrame([("a", 0), ("b", 7)], "assertion string, violations long")}, [("b", 7)]),
    }
    for name, (rows_, options, failed) in broken.items():
        with pytest.raises(Refused) as told:
            publish(rows_, str(tmp_path / "bad"), **options)
        assert [(r["assertion"], r["violations"]) for r in told.value.failed] == failed, name
    with pytest.raises(ValueError, match="lacks the columns nothing"):
        publish(df, str(tmp_path / "bad"), required=["nothing"])
    with pytest.raises(Exception, match="boom"):
        publish(df.withColumn("x", F.raise_error(F.lit("boom")).cast("int")), str(tmp_path / "bad"))
    assert os.listdir(tmp_path) == ["good"]
    publish_pool(df, str(tmp_path / "pool"), ["key"], "id", flags=["hard"])
    assert spark.read.parquet(str(tmp_path / "pool")).agg(F.max("row_id")).first()[0] == 50
    empty = str(tmp_path / "empty")
    publish(df.limit(0), empty, rules, unique=["key"], expected=0)
    assert spark.read.schema(df.schema).parquet(empty).count() == 0


def test_appending_other_columns_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, key string")
    path = str(tmp_path / "t")
    O.write_parquet(df, path)
    O.append_parquet(df.select("key", "id"), path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError, match="has the columns"):
        O.append_parquet(df.select(F.col("id").cast("int"), "key"), path)


def test_lines_are_split_once(spark):
    """Filters on parsed fields do not bring back the splitting, nor what makes the line."""
    made = spark.range(5).select(F.concat_ws("\t", F.md5(F.col("id").cast("string")), *[F.lit("30")] * 10).alias("value"))
    reads = T.parse_sam(made).filter(T.read_filter(30, 1)).select("qname", "mapq")
    plan = reads._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("split("), plan.count("md5(")) == (1, 1)
    assert reads.count() == 5


def test_hits_are_counted_where_they_arise(spark):
    """Behind the join of reads and sites nothing is shuffled; mates count once, ties by flag."""
    reads = [("a", 0, "chr1", 11, 60, "5M", "ACGTA", "IIIII"), ("a", 16, "chr1", 13, 60, "5M", "TTTTT", "JIII#"), ("b", 16, "chr1", 15, 60, "2M", "cg", "II")]
    reads = spark.createDataFrame(reads, "qname string, flag int, chrom string, start long, mapq int, cigar string, bases string, quals string")
    sites = spark.createDataFrame([("chr1", p) for p in (13, 14, 15, 16, 17, 40)], "chrom string, position long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = T.count_bases(sites, reads, extra=())
        names = [c for c in found.columns if c[1:2] == "_"]
        got = {r.position: {n: r[n] for n in names if r[n]} for r in found.collect()}
        executed = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {13: {"T_reverse": 1}, 14: {"T_forward": 1}, 15: {"A_forward": 1, "C_reverse": 1}, 16: {"T_reverse": 1, "G_reverse": 1}}
    assert "Exchange" in executed and "Exchange" not in executed.split("Join")[0]


def rows_of_join(df) -> int:
    """Rows that the one join of an executed plan has put out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan().executedPlan()
    while "Join" not in node.nodeName():
        node = node.plan() if "QueryStage" in node.nodeName() else node.children().head()
    return node.metrics().get("numOutputRows").get().value()


def test_reads_meet_bins_not_sites(spark):
    """What leaves the join of reads and sites does not grow with the sites that a read covers."""
    reads = [(f"q{i}", 0, "chr1", 100 + 40 * i, 60, "50M2D51M", "ACGTT" * 20 + "A", "I" * 101) for i in range(50)]
    reads = spark.createDataFrame(reads, "qname string, flag int, chrom string, start long, mapq int, cigar string, bases string, quals string")
    few, all_ = (spark.range(1, 2400, step).select(F.lit("chr1").alias("chrom"), F.col("id").alias("position")) for step in (200, 1))
    sparse, dense = T.count_bases(few, reads, extra=()), T.count_bases(all_, reads, extra=())
    assert rows_of_join(dense) == rows_of_join(sparse) < 2 * 50
    total = sum(r[f"{b}_forward"] for r in dense.collect() for b in "ACGT")
    assert total == 50 * 101


def test_bins_against_brute_force(monkeypatch):
    """Names and bins that go on over blocks, gaps, clips, missing qualities, letters that are no bases."""
    monkeypatch.setattr(S, "BLOCK", 3)
    rng = random.Random(5)
    cigars = ["30M", "3S20M2D7M", "10M600N20M", "5M1I24M", "2H30M", "10=5X15M", "*", "0M30M"]
    reads = []
    for i in range(300):
        bases = "".join(rng.choice("ACGTacgtNé") for _ in range(30))
        quals = "".join(chr(33 + rng.choice((10, 19, 20, 30, 30, 93))) for _ in range(rng.choice((30, 30, 30, 12))))
        name = None if i % 50 == 0 else f"q{rng.choice((i, i // 7, 0))}"
        reads.append((rng.choice("xy"), rng.choice(("c1", "c2")), name, rng.choice((0, 16, 99, 147)), rng.randint(-20, 1200), rng.choice(cigars), bases, quals))
    sites = {(c, p) for c in ("c1", "c2") for p in range(-20, 2000) if rng.random() < 0.6}

    best = {}
    for sample, chrom, name, flag, start, cigar, bases, quals in reads:
        at, i = start, 0
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
            for _ in range(int(n)):
                if op in "M=X" and (chrom, at) in sites and i < len(quals) and ord(quals[i]) - 33 >= 20 and bases[i].upper() in "ACGT":
                    mark = (33 - ord(quals[i]), flag, bases[i].upper())
                    key = (sample, chrom, at, name)
                    best[key] = min(best.get(key, mark), mark)
                at, i = at + (op in "M=XDN"), i + (op in "M=XIS")
    want = defaultdict(int)
    for (sample, chrom, at, _), (_, flag, base) in best.items():
        want[sample, chrom, at, f"{base}_{'reverse' if flag & 16 else 'forward'}"] += 1

    names = ["sample", "chrom", "qname", "flag", "start", "cigar", "bases", "quals"]
    table = pa.table([pa.array(c, pa.int32() if n == "flag" else None) for n, c in zip(names, zip(*reads))], names=names)
    kept = names[:4]
    cut = pa.Table.from_batches(S.cut_reads(table.to_batches(max_chunksize=40), kept, 20)).to_pylist()
    cut.sort(key=lambda r: (r["place"], r["sample"], r["chrom"], r["qname"] or ""))
    for _, rows in itertools.groupby(cut, lambda r: (r["place"], r["sample"], r["chrom"])):
        order = []
        for i, r in enumerate(rows, 1):
            order += [r["qname"]] if r["qname"] not in order else []
            bits = "".join(str(int((r["chrom"], r["place"] * S.WIDTH + 1 + k) in sites)) for k in range(S.WIDTH))
            r.update(row=i, name=len(order), wanted=int(bits, 2).to_bytes(S.WIDTH // 8, "big"))
    schema = pa.schema({"sample": pa.string(), "chrom": pa.string(), "place": pa.int64(), "row": pa.int32(), "name": pa.int32(), "flag": pa.int32(),
                        "at": pa.int32(), "bases": pa.binary(), "quals": pa.binary(), "wanted": pa.binary()})
    out = S.count_bins(pa.Table.from_pylist(cut, schema).to_batches(max_chunksize=7), ["sample", "chrom"], 20)
    got = {(r["sample"], r["chrom"], r["position"], n): r[n] for b in out for r in b.to_pylist() for n in S.COUNT_FIELDS if r[n]}
    assert got == want and len(got) > 1000
