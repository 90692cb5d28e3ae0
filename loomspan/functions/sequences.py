"""Functions on nucleotide sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"


def reverse_complement(seq: Column) -> Column:
    """Case stays; letters other than A, C, G, T and N stay as they are."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def complement(seq: Column) -> Column:
    """Complements of A, C, G and T; other letters stay."""
    return F.translate(seq, "ACGT", "TGCA")


def gap(size: int, letter: str = "n") -> Column:
    return F.repeat(F.lit(letter), size)


def wrap(seq: Column, width: int = 100) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def clean_name(name: Column) -> Column:
    """Pipes and dots of contig names become underscores."""
    return F.translate(name, "|.", "__")


def sample_name(name: Column) -> Column:
    return F.split_part(name, F.lit(":"), F.lit(1))


def recode_multiallelic(gt: Column) -> Column:
    """Second and third allele become the first two."""
    return F.translate(gt, "12", "01")


def motif_sites(seq: Column, motif: str) -> Column:
    """1-based starts of a motif, overlapping ones too."""
    ix = F.sequence(F.lit(1), F.greatest(F.length(seq) - len(motif) + 1, F.lit(1)))
    return F.filter(ix, lambda i: F.substring(seq, i, F.lit(len(motif))) == motif)
