from contactspark.operators.calls import vcf_bin_sums
from contactspark.sources import readers, writers


def test_vcf(spark, tmp_path):
    (tmp_path / "x.vcf").write_text("##fileformat=VCF\n#CHROM POS ID REF ALT QUAL\nc1\t12 . A ACGT 3\nc1 7001 . A T 1\nshort\n")
    got = readers.read_vcf(spark, str(tmp_path / "x.vcf"))
    assert sorted((r["chrom"], r["pos"], r["alt_len"]) for r in got.collect()) == [("c1", 12, 4), ("c1", 7001, 1)]
    assert sorted(tuple(r) for r in vcf_bin_sums(got).collect()) == [("c1", 0, 4), ("c1", 5000, 1)]


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one\nACGT\nAC\n>b\nTTT\n")
    assert sorted(tuple(r) for r in readers.read_fasta_lengths(spark, str(tmp_path / "x.fa")).collect()) == [("a", 6), ("b", 3)]
    assert readers.read_fasta_lengths(spark, str(tmp_path / "x.fa"), ["b"]).count() == 1


def test_calls_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([("1", "++", 5, 9)], "chr string, label string, start long, end long")
    writers.write_calls(df, str(tmp_path / "c"), sep=";")
    assert [tuple(r) for r in readers.read_sv_calls(spark, str(tmp_path / "c"), ";").collect()] == [("1", "++", 5, 9)]
    writers.write_stage(df, str(tmp_path / "s"), "one")
    assert writers.read_stage(spark, str(tmp_path / "s"), "one").count() == 1
    writers.write_results(spark.createDataFrame([(1, 2, "+-")], "bp_1 long, bp_2 long, label string"), str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).columns == ["bp_1", "bp_2", "label"]


def test_wide_calls_and_expected(spark, tmp_path):
    (tmp_path / "k562.tsv").write_text("chrom1\tpos1\tchrom2\tpos2\t++\t+-\t-+\t--\nc1\t1\tc1\t2\t0.1\t0.9\t0.9\t0\n")
    r = readers.read_wide_calls(spark, str(tmp_path)).first()
    assert r["source"] == "k562" and r["+-"] == 0.9
    (tmp_path / "e").mkdir()
    (tmp_path / "e/e.tsv").write_text("dist\tn_valid\tbalanced.sum\n0\t4\t2.5\n")
    assert tuple(readers.read_expected(spark, str(tmp_path / "e")).first()) == (0, 4, 2.5)


def test_contact_map(spark, tmp_path):
    rows = [("test", 5000, 0, 1, 0, 2, 7), ("test", 10000, 0, 0, 0, 1, 7), ("test", 50000, 0, 0, 0, 0, 7)]
    spark.createDataFrame(rows, "sample string, resolution int, chrom1_idx int, bin1 long, chrom2_idx int, bin2 long, count long").write.parquet(str(tmp_path / "pixels"))
    spark.createDataFrame([(0, "a", 9)], "chrom_idx int, chrom string, length long").write.parquet(str(tmp_path / "chromsizes"))
    spark.createDataFrame([(5000, 0, 0, 0, 0, 9, 1.0)], "resolution int, bin_id long, chrom_idx int, local_bin long, start long, end long, weight double").write.parquet(str(tmp_path / "bins"))
    m = readers.validated_map(spark, str(tmp_path), 5000)
    assert m["pixels"].count() == 1 and m["bins"].count() == 1
