import pytest
from pyspark.sql import functions as F

from loomspan.operators import mapping
from loomspan.sources import sequences, tables, vcf

VCF = """##fileformat=VCFv4.2
#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT P1 P2 F1:x F2
ctg.1 100 . A G 50 . NS=4;AF=0.4;DP=40 GT:AD 0/0:9,0 0/1:5,5 0/1:4,6 ./.:.
ctg.1 250 . C T 10 . NS=4;AF=0.3;DP=30 GT:AD 0/1:4,4 0/0:8,0 0/0:7,0 0/1:3,4
ctg.1 400 . G A . . NS=4;AF=0.01;DP=30 GT:AD 0/1:4,4 0/0:8,0 0/0:7,0 0/1:3,4
ctg|2 120 . A C,T 60 . NS=4;AF=0.5;DP=20 GT:AD 1/1:0,5,0 1/2:0,3,3 2/2:0,0,5 1/2:0,2,2
ctg|2 300 . A C,T 60 . NS=4;AF=0.5;DP=20 GT:AD 0/1:2,5,0 1/2:0,3,3 2/2:0,0,5 1/2:0,2,2
ctg|2 500 . T A,C,G 60 . NS=4;AF=0.5;DP=20 GT:AD 0/1:2,5 . . .
"""
LIMITS = {"min_qual": 30, "min_maf": 0.05, "max_missing": 0.2}


@pytest.fixture
def path(tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    return str(tmp_path / "x.vcf")


def test_vcf_filters_and_recoding(spark, path, tmp_path):
    assert vcf.header(spark, path) == ["P1", "P2", "F1", "F2"]
    rows = vcf.read_vcf(spark, path)
    assert {r.reason: r.n for r in vcf.filter_counts(rows, **LIMITS).collect()} == {"QUAL": 1, "MAF": 1, "MNP": 2, "MIS": 1, "pass": 1}
    sites = vcf.narrowed(vcf.filter_variants(rows, **LIMITS))
    r = sites.first()
    assert (r.contig, r.pos, r.ref, r.alt) == ("ctg_2", 120, "C", "T")
    assert [(c.gt, c.ad) for c in r.calls] == [("0/0", [5, 0]), ("0/1", [3, 3]), ("1/1", [0, 5]), ("0/1", [2, 2])]
    vcf.write_vcf(sites, ["P1", "P2", "F1", "F2"], str(tmp_path / "out"))
    again = vcf.read_vcf(spark, str(tmp_path / "out")).first()
    assert again.calls == ["0/0:5,0", "0/1:3,3", "1/1:0,5", "0/1:2,2"] and again.alt == "T"


def test_collection(spark, path, tmp_path):
    calls = vcf.with_marker_index(vcf.call_rows(vcf.narrowed(vcf.read_vcf(spark, path)), vcf.header(spark, path)))
    vcf.write_collection(calls, str(tmp_path / "c"))
    back = vcf.read_collection(spark, str(tmp_path / "c"), ["ctg_1"])
    assert back.count() == 12 and back.where("sample = 'F2' AND pos = 100").first().ref_depth == 0
    ranges = spark.createDataFrame([("ctg_1", 200, 400)], "contig string, start int, end int")
    assert vcf.read_collection(spark, str(tmp_path / "c"), None, ranges).select("pos").distinct().count() == 2
    assert [(r.contig, r.n_markers) for r in vcf.catalog(calls).orderBy("ix").collect()] == [("ctg_1", 3), ("ctg_2", 3)]
    errors = spark.createDataFrame([("ctg_1", 200.0), ("ctg_1", 300.0)], "contig string, left double")
    assert sorted(r.contig for r in vcf.split_contigs(vcf.narrowed(vcf.read_vcf(spark, path)), errors).collect()) == ["ctg_1_1", "ctg_1_2", "ctg_1_3"]
    assert vcf.merge_samples(calls.withColumn("sample", F.lit("x"))).where("pos = 100").first().ref_depth == 18


def test_headers_are_checked(spark, tmp_path):
    for i, head in enumerate(("#CHROM POS ID REF ALT QUAL FILTER INFO", "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT a:1 a:2")):
        (tmp_path / f"{i}.vcf").write_text(head + "\n")
        with pytest.raises(ValueError):
            vcf.header(spark, str(tmp_path / f"{i}.vcf"))


def test_fasta_and_agp(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nAC\n>c2\nGGNN\n>c3\n\n")
    seqs = sequences.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {(r.name, r.seq, r.length) for r in seqs.collect()} == {("c1", "ACGTAC", 6), ("c2", "GGNN", 4), ("c3", "", 0)}
    assert sequences.read_fasta(spark, str(tmp_path / "a.fa"), revcomp=True).where("name = 'c2_rc'").first().seq == "NNCC"
    assert {r.name for r in sequences.fasta_names(spark, str(tmp_path / "a.fa")).collect()} == {"c1", "c2", "c3"}
    assert {r["sample"] for r in sequences.read_fasta_folder(spark, str(tmp_path)).collect()} == {"a"}
    sequences.write_fasta(seqs, str(tmp_path / "out"), 4)
    assert {(r.name, r.seq) for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == {("c1", "ACGTAC"), ("c2", "GGNN"), ("c3", "")}
    parts = spark.createDataFrame([("chr01", 0, "A", 500, "+"), ("chr01", 1, "B", 200, "-")], "object string, ord int, component string, length int, strand string")
    sequences.write_agp(parts, 1000, str(tmp_path / "agp"))
    assert [r[0].split("\t") for r in spark.read.text(str(tmp_path / "agp")).collect()] == [
        ["chr01", "1", "500", "1", "W", "A", "1", "500", "+"], ["chr01", "501", "1500", "2", "N", "gap", "1", "1000", "+"], ["chr01", "1501", "1700", "3", "W", "B", "1", "200", "-"],
    ]


def test_interchange_texts(spark, tmp_path):
    pairs = spark.createDataFrame([(0.0, 0.25, 0.25, 0.0, 0.0, "A", "B", 8)], tables.RF_SCHEMA)
    tables.write_rf(pairs, str(tmp_path / "rf"))
    assert [tuple(r) for r in tables.read_rf(spark, str(tmp_path / "rf")).collect()] == [(0.0, 0.25, 0.25, 0.0, 0.0, "A", "B", 8)]
    (tmp_path / "m.map").write_text("C c1\nD 150,200\n0.01,0.02\n0.03,0.04\nC c2\nD 7\n0.5\n")
    assert {(r.contig, tuple(r.dist), tuple(round(x, 9) for x in r.rf)) for r in tables.read_contig_map(spark, str(tmp_path / "m.map")).collect()} == {("c1", (150, 200), (0.02, 0.03)), ("c2", (7,), (0.5,))}
    (tmp_path / "l.mct").write_text("group\tLG1\nA(+)\t0\nA(-)\t10.1\nB(-)\t12\nB(+)\t20\n\ngroup\tLG2\nC(+)\t0\nC(-)\t1\n")
    rows = tables.read_linkage_map(spark, str(tmp_path / "l.mct"))
    assert sorted((r.lg, r.ord, r.contig, r.strand, r.cm_start, r.cm_end) for r in rows.collect()) == [(1, 0, "A", "+", 0, 10.1), (1, 1, "B", "-", 12, 20), (2, 0, "C", "+", 0, 1)]
    assert tables.linkage_map_lines(rows).first()[0].split("\n")[1:3] == ["A(+)\t0.0", "A(-)\t10.1"]
    (tmp_path / "s.nns").write_text("-c A:B -s 0.0 -r false:true\n-c Z\n")
    scaffolds = tables.read_scaffolds(spark, str(tmp_path / "s.nns"))
    assert sorted((r.ord, r.contig, r.gap_rf, r.reversed) for r in scaffolds.collect()) == [(0, "A", 0.0, False), (0, "Z", None, False), (1, "B", None, True)]
    assert {r[0] for r in tables.scaffold_lines(scaffolds).collect()} == {"-c A:B -s 0.0 -r false:true", "-c Z"}
    (tmp_path / "d.txt").write_text("3\n2\nP1 P2 F1\nx\ny\nm1 100 A,B 3,1 0,4 .\nm2 180 A,B 6,2 5,0 2,2\n")
    got = tables.read_depths(spark, str(tmp_path / "d.txt")).collect()
    assert len(got) == 6 and {(r.id, r["sample"], r.ref, r.alt) for r in got} >= {("m1", "F1", 0, 0), ("m2", "P1", 6, 2)}
    (tmp_path / "e.err").write_text("c1\t200\t250\t0.3\nc1\t10\t20\t0.2\n")
    assert [e.left for e in tables.read_errors(spark, str(tmp_path / "e.err")).first().errors] == [10.0, 200.0]
    (tmp_path / "k.cfg").write_text("A : 1\nB: two\n")
    assert tables.read_config(spark, str(tmp_path / "k.cfg")) == {"A": "1", "B": "two"}
    (tmp_path / "r.txt").write_text("##ploidy: 4\n##seed: 17\n")
    assert tables.read_run_details(spark, str(tmp_path / "r.txt")).first().details == {"ploidy": "4", "seed": "17"}
    line = spark.createDataFrame([("m\t\t\t1-> {A,0.9;B,0.1} {A,0.2;B,0.8}",)], "v string")
    assert line.select(tables.emission_probabilities(F.col("v"))).first()[0] == [0.9, 0.2]


def test_pseudomolecules_and_breaks(spark):
    rows = spark.createDataFrame([(1, 0, "a_1", "+"), (1, 1, "b", "-"), (1, 2, "a_2", "+")], "lg long, ord int, contig string, strand string")
    seqs = spark.createDataFrame([("a", "AAAACCCCGGGG"), ("b", "ACG")], "name string, seq string")
    errors = spark.createDataFrame([("a", 4.0, 9.0, 0.3)], "contig string, left double, right double, rf double")
    molecules, parts = mapping.pseudomolecules(rows, seqs, errors, gap=2)
    assert molecules.first().seq == "AAAA" + "nn" + "CGT" + "nn" + "GGGG"
    assert parts.count() == 3


def test_fractions_compressed_and_unsorted(spark, tmp_path):
    """Each pair is computed once, names come from their own table, and packed texts read back whole."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "rf_min double, rf0 double, rf1 double, rf2 double, rf3 double, a string, b string, n int"
    want = [(i / 70, i / 70, 0.1, 0.2 + i / 1000, 0.3, f"c{i % 7}", f"d{i}", i) for i in range(200)]
    pairs = spark.createDataFrame(want, schema).repartition(5, "b").mapInPandas(count, schema)
    names = spark.createDataFrame([(x,) for x in [f"c{i}" for i in range(8)] * 2], "contig string")
    path = tmp_path / "rf"
    tables.write_rf(pairs, str(path), names, in_order=False, compression="gzip")
    assert seen.value == len(want)
    assert all(f.name.endswith(".gz") for f in path.glob("part-*"))
    assert sorted(r.value for r in spark.read.text(str(path)).where("value LIKE '##%'").collect()) == [f"##c{i}" for i in range(8)]
    assert sorted(tuple(r) for r in tables.read_rf(spark, str(path)).collect()) == sorted(want)
