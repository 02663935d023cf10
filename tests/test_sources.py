import struct

import pytest
from pyspark.sql import functions as F

from amploom import cli
from amploom.functions import kernels as K
from amploom.functions import kmers as KM
from amploom.sources import models, signalbin
from amploom.streaming.cusum import cusum_stream

ROWS = [(i, f"00000000-0000-0000-0000-{i:012d}", "chr" + str(i % 3), [float(i), 1.5, -2.25], [0, 1, i], None) for i in range(7)]


def test_record_round_trip():
    b = signalbin.encode_record("u" * 36, "c", [1.5], [3], trailing=True)
    (n,) = struct.unpack_from("<i", b, 36)
    frame = b[40 + n + 4 :]
    assert signalbin.decode_payload(frame) == ([1.5], [3], None)
    b = signalbin.encode_record("u" * 36, "", [], [], "ACGT")
    assert signalbin.decode_payload(b[44:]) == ([], [], "ACGT")


def test_source_and_sink(spark, tmp_path):
    signalbin.register(spark)
    df = spark.createDataFrame(ROWS, signalbin.SCHEMA)
    out = str(tmp_path / "reads")
    df.coalesce(1).sortWithinPartitions("read_index").write.format("signalbin").mode("append").save(out)
    back = spark.read.format("signalbin").option("partitionBytes", 60).load(out)
    assert sorted(map(tuple, back.collect())) == ROWS
    assert back.where("read_index = 3").select("uuid").collect()[0][0] == ROWS[3][1] and back.count() == 7
    assert [r.uuid for r in spark.read.format("signalbin").option("readIndex", 3).load(out).collect()] == [ROWS[3][1]]
    head = spark.read.format("signalbin").option("headerOnly", True).load(out)
    assert head.where(F.col("signal").isNotNull()).count() == 0 and head.count() == 7
    assert cli.summary_lines(back, 2) == ["INDEX\tUUID\tCHROM\tSIGNAL_COUNT", f"0\t{ROWS[0][1]}\tchr0\t3", f"1\t{ROWS[1][1]}\tchr1\t3"]
    assert cli.show_lines(back, 1)[5] == f"{1.0:14.3f}{0:>12}"


def test_driver_reads_no_headers_of_its_own_files(spark, tmp_path, monkeypatch):
    signalbin.register(spark)
    out = str(tmp_path / "reads")
    df = spark.createDataFrame([(i, f"00000000-0000-0000-0000-{i:012d}", "c", [float(i)] * (i % 4), [i], "A" * (i % 2) or None) for i in range(200)], signalbin.SCHEMA)
    for part in (df.where("read_index < 90"), df.where("read_index >= 90")):
        part.repartitionByRange(6, "read_index").sortWithinPartitions("read_index").write.format("signalbin").mode("append").save(out)
    monkeypatch.setattr(signalbin, "headers", None)
    ranges = signalbin.SignalBinReader({"path": out}, df.schema).partitions()
    monkeypatch.undo()
    assert len(ranges) == 12 and sorted(r.first for r in ranges)[0] == 0
    back = spark.read.format("signalbin").load(out).collect()
    assert sorted(r.read_index for r in back) == list(range(200))
    assert sorted(tuple(r)[1:] for r in back) == sorted(tuple(r)[1:] for r in df.collect())
    one = signalbin._files(out)[0]
    found = signalbin.marks_of(one, 100)
    assert len(found["marks"]) > 3 and [h for a, b in zip([m["at"] for m in found["marks"]], [m["at"] for m in found["marks"]][1:] + [None]) for h in signalbin.headers(one, a, b)] == list(signalbin.headers(one))


def test_one_record_opens_one_range(spark, tmp_path):
    signalbin.register(spark)
    out = str(tmp_path / "reads")
    name = lambda i: f"00000000-0000-0000-0000-{i * 7919 % 400:012d}"
    df = spark.createDataFrame([(i, name(i), f"chr{i // 100}", [float(i)] * 20, [i], None) for i in range(400)], signalbin.SCHEMA)
    for part in (df.where("read_index < 200"), df.where("read_index >= 200")):
        part.repartitionByRange(4, "read_index").sortWithinPartitions("read_index").write.format("signalbin").mode("append").save(f"{out}/day{part.first().read_index}")
    ranges = lambda **o: signalbin.SignalBinReader({"path": out, "partitionbytes": 500} | {k.lower(): v for k, v in o.items()}, df.schema).partitions()
    assert len(ranges()) == 8 and len(ranges(readIndex=301)) == 1 and len(ranges(chrom="chr3")) < 4 and len(ranges(uuid=name(33))) <= 3
    assert ranges(readIndex=4000)[0].stop == 0
    back = {r.read_index: r for r in spark.read.format("signalbin").load(out).collect()}
    for i in (0, 301, 399):
        only = signalbin.SignalBinReader({"path": out, "readindex": i}, df.schema)
        found = [r for part in only.partitions() for b in only.read(part) for r in b.to_pylist()]
        assert [r["uuid"] for r in found] == [back[i].uuid] and len(only.partitions()) == 1
    got = spark.read.format("signalbin").option("uuid", name(33)).load(out).collect()
    assert [r.signal for r in got] == [[33.0] * 20] and spark.read.format("signalbin").option("uuid", "x" * 36).load(out).count() == 0
    foreign = signalbin.marks_of(signalbin._files(out)[0], 300)
    assert len(foreign["marks"]) > 3 and all(signalbin.may_have(m, u, c) for m in foreign["marks"] for u, c, at, _ in signalbin.headers(signalbin._files(out)[0], m["at"], m["at"] + 1))


def test_writes_at_the_same_time_and_failed_tasks(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    signalbin.register(spark)
    out = tmp_path / "reads"
    df = spark.createDataFrame(ROWS, signalbin.SCHEMA).coalesce(1)
    # a frame made in a thread makes the session that thread's
    save = lambda rows: spark.createDataFrame(rows, signalbin.SCHEMA).coalesce(1).write.format("signalbin").mode("append").save(str(out))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(save, (ROWS[:3], ROWS[3:])))
    files, marks = signalbin._listed(str(out))
    assert len(files) == len(marks) == 2 and set(signalbin._load_marks(marks)) == set(files)
    assert spark.read.format("signalbin").load(str(out)).count() == 7
    bad = spark.createDataFrame([ROWS[0], (1, "short", "c", [1.0], [1], None)], signalbin.SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="36 bytes"):
        bad.write.format("signalbin").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["_signalbin", *sorted(f.rsplit("/", 1)[1] for f in files)]
    df.where("read_index = 5").write.format("signalbin").mode("overwrite").save(str(out))
    assert [len(x) for x in signalbin._listed(str(out))] == [1, 1] and spark.read.format("signalbin").load(str(out)).count() == 1


def test_label_and_score_leave_out_short_reads(spark, tmp_path, monkeypatch):
    from amploom.plans.registry import CLASSES, TWO_STATES

    rows = [(0, ROWS[0][1], "chr1", [20.0, 90.0] * 3, [0] * 6, None), (1, ROWS[1][1], "chr2", [20.0] * 2, [0] * 2, None)]
    spark.createDataFrame(rows, signalbin.SCHEMA).write.parquet(str(tmp_path / "in.parquet"))
    monkeypatch.setattr(cli, "session", lambda name: spark)
    for model, command, out in ((CLASSES, "score", "score.tsv"), (TWO_STATES, "label", "labelled")):
        (tmp_path / "model.json").write_text(model)
        args = [command, "--input", str(tmp_path / "in.parquet"), "--model", str(tmp_path / "model.json"), "--output", str(tmp_path / out)]
        assert cli.main([*args, "--min-samples", "5"]) == 0
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "score.tsv")).count() == 1
    assert [r.uuid for r in spark.read.format("signalbin").load(str(tmp_path / "labelled")).collect()] == [ROWS[0][1]]
    assert cli.parser().parse_args(args).min_samples == 3000


def test_cut_record_is_an_error(tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(signalbin.encode_record("u" * 36, "c", [1.0], [1])[:-3])
    with pytest.raises(ValueError, match="byte 0 is cut short"):
        list(signalbin.headers(str(p)))


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a first\r\nAC\r\n\r\nGT\n>b\nTT\n")
    assert sorted(map(tuple, models.read_fasta(spark, str(p)).collect())) == [("a", "ACGT"), ("b", "TT")]
    q = tmp_path / "signs.fa"
    q.write_bytes(b">a left>right\nAC\nGT\n>b\r\nTT\r\n>\n")
    assert sorted(map(tuple, models.read_fasta(spark, str(q)).collect())) == [("a", "ACGT"), ("b", "TT")]
    for name, head in (("c.fa", "; comment\nJUNK\n"), ("d.fa", "JUNK"), ("e.fa", "\n\n")):
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / name).write_text(f"{head}\n>{name} left>right\nACGT\n>\nX\n")
    assert sorted(map(tuple, models.read_fasta(spark, str(tmp_path / "many")).collect())) == sorted([(n, "ACGT") for n in ("c.fa", "d.fa", "e.fa")] + [("", "X")] * 3)
    assert models.fasta_sequence(spark, str(p), "a") == "ACGT" and models.fasta_sequence(spark, str(p), "z") == ""


def test_kmers(spark):
    one = spark.createDataFrame([("ACGTTA", "ACG", "AC")], "s string, t string, short string")
    r = one.select(KM.kmer_codes(F.col("s"), 3), KM.kmer_strings(F.col("t"), 3, 1), KM.kmer_codes(F.col("short"), 3), KM.kmers_of_codes(KM.kmer_codes(F.col("s"), 3), 3)).first()
    assert list(r) == [[11, 45, 53, 20], ["NAC", "ACG", "CGN"], [], "ACGTTA"]
    band = one.select(KM.uniform_band(F.lit(5), 2, 2).alias("b")).first().b
    assert [tuple(x) for x in band] == [(0, 0), (1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1)]


def test_stream_equals_batch(spark, tmp_path):
    x = [1.0, 2.0] * 8 + [11.0, 12.0] * 8
    src = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([(1, i, x[i]) for i in range(8 * k, 8 * k + 8)], "read_index long, pos long, x double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("read_index long, pos long, x double").option("maxFilesPerTrigger", 10).parquet(str(src))
    q = cusum_stream(stream, K.min_window_std(__import__("numpy").array(x))).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [r.seg for r in spark.sql("select * from segs order by pos").collect()]
    assert got == K.cusum(__import__("numpy").array(x)).tolist()
