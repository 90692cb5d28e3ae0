"""Programs from files to files, on a small simulated family."""

import random

import pytest

from loomspan.plans import programs
from loomspan.sources import vcf


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("programs")
    r = random.Random(2)
    (d / "ref.fa").write_text("".join(f">k{i}\n{''.join(r.choice('ACGT') for _ in range(9000))}\n" for i in (1, 2)))
    programs.main(["PopSimulation", "--input", str(d / "ref.fa"), "--output", str(d / "pop"), "--size", "36", "--seed", "4"])
    truth = spark.read.parquet(str(d / "pop/truth"))
    rows, names = {}, [f"P{i}" for i in (1, 2)] + [f"F{i}" for i in range(1, 35)]
    for x in truth.collect():
        n = [r.choice([6, 8, 10]) for _ in range(1)][0]
        alt = sum(r.random() < sum(x.alleles) / 2 for _ in range(n))
        rows.setdefault((x.chrom, x.pos, x.ref, x.alt), {})[x.sample] = f"{'/'.join(map(str, sorted(x.alleles)))}:{n - alt},{alt}"
    body = "".join(f"{c}\t{p}\t.\t{a}\t{b}\t60\t.\tAF=0.5;DP=300\tGT:AD\t" + "\t".join(v[s] for s in names) + "\n" for (c, p, a, b), v in sorted(rows.items()))
    (d / "x.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(names) + "\n" + body)
    return d


def test_simulated_files(spark, folder):
    assert spark.read.text(str(folder / "pop/ped")).count() == 37
    genome = spark.read.text(str(folder / "pop/genomes"))
    assert genome.where("value LIKE '>%'").count() == 36 * 2 * 2
    programs.main(["gbssimulation", "--input", str(folder / "ref.fa"), "--output", str(folder / "reads"), "--depth", "2", "--depth-sd", "1"])
    assert spark.read.text(str(folder / "reads")).count() % 4 == 0


def test_from_calls_to_a_map(spark, folder):
    d = folder
    programs.main(["datapreparation", "--input", str(d / "x.vcf"), "--output", str(d / "prep"), "--min-qual", "30", "--min-maf", "0.05"])
    assert vcf.read_vcf(spark, str(d / "prep.vcf")).count() > 10
    programs.main(["haplotyper", "--input", str(d / "prep.collection"), "--output", str(d / "fits"), "--repeats", "2"])
    for name, args in {"twopoint": [], "singlepoint": [], "asmerr": ["--calls", str(d / "prep.vcf")], "evaluator": ["--truth", str(d / "truth")]}.items():
        if name == "evaluator":
            spark.read.parquet(str(d / "pop/truth")).withColumnRenamed("chrom", "contig").write.parquet(str(d / "truth"))
        programs.main([name, "--input", str(d / "fits"), "--output", str(d / name), *args])
    programs.main(["superscaffold", "--input", str(d / "twopoint"), "--output", str(d / "nns")])
    (d / "maps.map").write_text("".join(f.read_text() for f in sorted((d / "singlepoint").glob("part*"))))
    programs.main(["map", "--input", str(d / "twopoint"), "--output", str(d / "mct"), "--maps", str(d / "maps.map")])
    (d / "all.mct").write_text("".join(f.read_text() for f in sorted((d / "mct").glob("part*"))))
    programs.main(["chromosomer", "--input", str(d / "all.mct"), "--output", str(d / "chr"), "--sequences", str(d / "ref.fa")])
    assert spark.read.parquet(str(d / "chr.agp")).count() >= 2
    assert float(spark.read.csv(str(d / "evaluator"), header=True).first().accuracy) > 0.6


def test_whole_way(spark, folder):
    out = programs.endtoend(spark, str(folder / "x.vcf"), ["P1", "P2"], 2, repeats=2, seed=3)
    assert out["linkage_map"].select("contig").distinct().count() == 2 and out["errors"].count() == 0
