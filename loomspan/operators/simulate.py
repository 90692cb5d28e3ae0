"""Seeded simulators: an F1 family with known phase, and reads from restriction fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Mean gaps between markers in base pairs, and their parts.
GAP_MEANS = (50, 150, 500, 1500, 5000)
GAP_PARTS = (0.05, 0.15, 0.3, 0.3, 0.2)
REFERENCE_PART, MORGAN_BP = 0.75, 1e8
BASES = "ACGT"
#: Recognition motifs and cut offsets.
ENZYMES = {"ApeKI": (("GCAGC", "GCTGC"), 1), "PstI": (("CTGCAG",), 5), "TseI": (("GCAGC", "GCTGC"), 1), "EcoT22I": (("ATGCAT",), 5), "MspI": (("CCGG",), 1)}
#: Fixed values of the assay: length of the strand that a cut leaves, the common adapter, the qualities from '!' on, and of
#: each base the wrong ones, the likeliest (0.6) first.
OVERHANGS = {"ApeKI": 4, "PstI": 1, "TseI": 4, "EcoT22I": 1, "MspI": 3}
ADAPTER = "AGATCGGAAGAGCGGTTCAGCAGGAATGCCGAG"
QUALITIES = "!\"#$%&'()*+,-./0123456789:;<=>?@ABCDEFGHIJ"
MISSING_QUALITY = "#"
WRONG = {"A": "TCG", "T": "ACG", "C": "GAT", "G": "CAT"}
#: Barcode files come with these enzymes; for others one must be given.
BARCODED = ("ApeKI", "PstI", "TseI")
ERROR_RATE, INDEL_RATE, READ_LENGTH, MIN_FRAGMENT = 0.003, 0.5, 101, 100


def barcode_source(enzyme: str, given: str | None = None) -> str:
    """Name of the barcode file: the given one, or the enzyme's own."""
    if given:
        return given
    for name in BARCODED:
        if name.lower() == enzyme.lower():
            return f"barcodes-{name}.csv"
    raise ValueError(f"no barcodes for {enzyme}: give a file")


def _seed(*parts) -> int:
    import zlib

    return zlib.crc32(":".join(map(str, parts)).encode())


def pedigree(spark: SparkSession, size: int) -> DataFrame:
    """P1, P2 and F1 to Fn with their roles 0, 1, 2."""
    names = F.when(F.col("id") < 2, F.concat(F.lit("P"), (F.col("id") + 1).cast("string"))).otherwise(F.concat(F.lit("F"), (F.col("id") - 1).cast("string")))
    return spark.range(size).select(F.col("id").cast("int").alias("sample_ix"), names.alias("sample"), F.least(F.col("id"), F.lit(2)).cast("int").alias("role"))


def markers(chromosomes: DataFrame, ploidy: int, seed: int) -> DataFrame:
    """chrom, marker_ix, pos, ref, alt, founders: polymorphic sites along chromosomes (chrom, length). Each is one task."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(_seed(seed, "markers", key[0]))
        length, at, rows = int(pdf["length"].iloc[0]), 0, []
        while True:
            at += 1 + rng.poisson(GAP_MEANS[rng.choice(len(GAP_MEANS), p=GAP_PARTS)])
            if at > length:
                break
            ref, alt = rng.choice(4, 2, replace=False)
            founders = (rng.random(2 * ploidy) > REFERENCE_PART).astype(int)
            if founders.min() == founders.max():
                founders[rng.integers(2 * ploidy)] ^= 1
            rows.append((key[0], len(rows), at, BASES[ref], BASES[alt], founders.tolist()))
        return pd.DataFrame(rows, columns=["chrom", "marker_ix", "pos", "ref", "alt", "founders"])

    return chromosomes.groupBy("chrom").applyInPandas(one, "chrom string, marker_ix int, pos int, ref string, alt string, founders array<int>")


def gamete(rng: np.random.Generator, positions: np.ndarray, ploidy: int, preference: float = 0.0) -> np.ndarray:
    """(H/2, M) founders 0..H-1 of one parent: pairs of homologues, crossovers without interference.

    With a probability of ``preference`` the pairs are the neighbours (0 with 1, 2 with 3, ...); else they are drawn.
    """
    out = np.zeros((ploidy // 2, len(positions)), int)
    order = np.arange(ploidy) if preference and rng.random() < preference else rng.permutation(ploidy)
    change = 0.5 * (1 - np.exp(-2 * np.diff(positions) / MORGAN_BP))
    for k in range(ploidy // 2):
        pair = order[2 * k : 2 * k + 2]
        swaps = np.concatenate(([rng.integers(2)], rng.random(len(change)) < change)).astype(int)
        out[k] = pair[np.cumsum(swaps) % 2]
    return out


def genotypes(sites: DataFrame, family: DataFrame, ploidy: int, seed: int, pairing: bool = False) -> DataFrame:
    """chrom, sample_ix, sample, role, marker_ix, pos, ref, alt, founders (labels from 1), alleles: the truth, one task a chromosome and sample.

    With ``pairing`` each chromosome has its own preference for pairs of neighbours, from 0.5 to 1.
    """
    packed = sites.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("marker_ix", "pos", "ref", "alt", "founders"))).alias("m"))

    def one(batches):
        for pdf in batches:
            rows = []
            for chrom, ix, sample, role, m in zip(pdf.chrom, pdf.sample_ix, pdf["sample"], pdf.role, pdf.m, strict=True):
                rng = np.random.default_rng(_seed(seed, "meiosis", chrom, ix))
                positions = np.array([x["pos"] for x in m], float)
                preference = 0.5 + 0.5 * np.random.default_rng(_seed(seed, "pairing", chrom)).random() if pairing else 0.0
                if role < 2:
                    f = np.repeat(np.arange(ploidy)[:, None] + role * ploidy, len(m), axis=1)
                else:
                    f = np.concatenate((gamete(rng, positions, ploidy, preference), gamete(rng, positions, ploidy, preference) + ploidy))
                alleles = np.take_along_axis(np.array([x["founders"] for x in m]), f.T, axis=1)
                rows.append(pd.DataFrame({"chrom": chrom, "sample_ix": ix, "sample": sample, "role": role, **{c: [x[c] for x in m] for c in ("marker_ix", "pos", "ref", "alt")}, "founders": (f.T + 1).tolist(), "alleles": alleles.tolist()}))
            yield pd.concat(rows) if rows else pd.DataFrame(columns=["chrom", "sample_ix", "sample", "role", "marker_ix", "pos", "ref", "alt", "founders", "alleles"])

    units = packed.join(F.broadcast(family)).repartition("chrom", "sample_ix")  # chromosomes times a family
    return units.select("chrom", "sample_ix", "sample", "role", "m").mapInPandas(one, "chrom string, sample_ix int, sample string, role int, marker_ix int, pos int, ref string, alt string, founders array<int>, alleles array<int>")


def depths(truth: DataFrame, mean: float, seed: int, error: float = 0.01) -> DataFrame:
    """Calls with Poisson depths: ref_depth and alt_depth by the sample's alleles and a rate of wrong reads. One task a chromosome and sample."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("marker_ix")
        rng = np.random.default_rng(_seed(seed, "depth", key[0], key[1]))
        a = np.stack(pdf.alleles.to_list()).mean(axis=1)
        n = rng.poisson(mean, len(pdf))
        alt = rng.binomial(n, a * (1 - error) + (1 - a) * error)
        return pd.DataFrame({"contig": pdf.chrom, "marker_ix": pdf.marker_ix, "pos": pdf.pos, "sample_ix": pdf.sample_ix, "sample": pdf["sample"], "ref_depth": n - alt, "alt_depth": alt})

    return truth.groupBy("chrom", "sample_ix").applyInPandas(one, "contig string, marker_ix int, pos int, sample_ix int, sample string, ref_depth int, alt_depth int")


def fragments(sequences: DataFrame, enzyme: str = "ApeKI", efficiency: float = 0.95, seed: int = 0) -> DataFrame:
    """name, n, start, stop, fragment: pieces between cuts; each site is cut or not by a hash, so a rerun cuts the same."""
    motifs, offset = ENZYMES[enzyme]
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - len(motifs[0]) + 1, F.lit(1)))
    hit = lambda i: F.upper(F.substring(F.col("seq"), i, F.lit(len(motifs[0])))).isin(*motifs) & (F.pmod(F.xxhash64("name", i, F.lit(seed)), F.lit(10_000)) < int(efficiency * 10_000))
    cuts = F.transform(F.filter(starts, hit), lambda i: i + offset)
    edges = F.concat(F.array(F.lit(1)), cuts, F.array(F.length("seq") + 1))
    # the site at either end; none at the ends of the sequence
    site = lambda e: F.when((e > 1) & (e <= F.length("seq")), F.upper(F.substring(F.col("seq"), (e - offset).cast("int"), F.lit(len(motifs[0]))))).otherwise("")
    spans = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct(a.alias("start"), (b - 1).alias("stop"), site(a).alias("left_site"), site(b).alias("right_site")))
    rows = sequences.select("name", "seq", F.posexplode(spans).alias("n", "s"))
    return rows.select("name", "n", "s.start", "s.stop", F.substring(F.col("seq"), F.col("s.start"), F.col("s.stop") - F.col("s.start") + 1).alias("fragment"), "s.left_site", "s.right_site")


def overhang(site: str, length: int) -> tuple[str, str]:
    """What a cut site leaves before and after a fragment: the stretch that both strands' cuts enclose."""
    n = len(site)
    if 2 * length > n:
        return "", site[n - length : length]
    return site[length : n - length], ""


class QualityChain:
    """Qualities as a Markov chain along a read, and the chances that a base is missing (after a base, after a missing one).

    ``moves``: for each position and quality (the last row: no quality before) the running probabilities of the next one.
    """

    def __init__(self, missing: np.ndarray, missing_on: np.ndarray, first: np.ndarray, steps: np.ndarray):
        self.missing, self.missing_on = missing, missing_on
        total = np.cumsum(first, axis=1)
        start = total / np.maximum(total[:, -1:], 1e-300)
        run = np.cumsum(steps, axis=2)
        # a quality that was never left goes on as a read begins
        empty = run[:, :, -1] == 0
        run = np.where(empty[:, :, None], start[:, None, :], run / np.where(empty, 1, run[:, :, -1])[:, :, None])
        self.moves = np.concatenate((run, start[:, None, :]), axis=1)

    @classmethod
    def parse(cls, lines: list[str], length: int = READ_LENGTH) -> "QualityChain":
        """Comma-separated rows, '#' lines between: two of missing chances, then for each position the first and all moves."""
        rows = [np.array(x.split(","), float) for x in lines if x.strip() and not x.startswith("#")]
        k = len(rows[2])
        body = np.stack(rows[2 : 2 + length * (k + 1)]).reshape(length, k + 1, k)
        return cls(rows[0][:length], rows[1][:length], body[:, 0], body[:, 1:])

    @classmethod
    def simple(cls, length: int = READ_LENGTH, k: int = len(QUALITIES)) -> "QualityChain":
        """High qualities that drift by one step."""
        first = np.exp(-0.5 * ((np.arange(k) - 36) / 2) ** 2)
        step = np.clip(1 - np.abs(np.arange(k)[:, None] - np.arange(k)[None]), -1, 1)
        step = np.where(step >= 0, 1.0, 0.0)
        step[:, :3] = 0
        return cls(np.full(length, 0.0005), np.full(length, 0.3), np.tile(first, (length, 1)), np.tile(step, (length, 1, 1)))


def read_quality_chain(spark: SparkSession, path: str) -> QualityChain:
    """The parameter file of a chain (some megabytes; the driver parses it and the tasks get it as a broadcast)."""
    text = spark.read.text(path, wholetext=True).select(F.octet_length("value").alias("n"), "value")
    if (text.agg(F.sum("n")).first()[0] or 0) > 1 << 26:
        raise ValueError(f"{path} is too large for the parameters of a chain")
    return QualityChain.parse(text.first()["value"].split("\n"))


def _uniform(keys: np.ndarray, stream: int, n: int) -> np.ndarray:
    """(len(keys), n) numbers in [0, 1) that depend on the key, the stream and the place alone."""
    with np.errstate(over="ignore"):
        x = keys[:, None] + (np.arange(n, dtype=np.uint64) + np.uint64(stream << 20)) * np.uint64(0x9E3779B97F4A7C15)
        for shift in (30, 27):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def reads(pieces: DataFrame, mean: float, sd: float, barcode: str, seed: int, enzyme: str = "ApeKI", chain: QualityChain | None = None) -> DataFrame:
    """FASTQ records (id, seq, qual) of both strands of fragments of at least 100 letters.

    A read is barcode, overhang, insert, overhang and adapter with wrong, extra and lost bases, cut or padded to 101; its
    qualities and missing bases come from the chain, all reads of a batch position by position. The id ends with the counts
    of the three kinds of errors. The same seed gives the same reads however the fragments are partitioned.
    """
    held = pieces.sparkSession.sparkContext.broadcast(chain or QualityChain.simple())
    length = OVERHANGS[enzyme]

    def one(batches):
        model = held.value
        for pdf in batches:
            ids, texts, keys = [], [], []
            for name, n, fragment, left, right in zip(pdf.name, pdf.n, pdf.fragment, pdf.left_site, pdf.right_site, strict=True):
                rng = np.random.default_rng(_seed(seed, "reads", name, n))
                for strand in "+-":
                    a, b = (left, right) if strand == "+" else (_turned(right), _turned(left))
                    text = barcode + overhang(a, length)[0] + (fragment if strand == "+" else _turned(fragment)) + overhang(b, length)[1] + ADAPTER
                    for k in range(max(0, round(rng.normal(mean, sd)))):
                        read, errors = _with_errors(rng, text)
                        ids.append(f"@{name}:{n}:{strand}:{k}:{':'.join(map(str, errors))}")
                        texts.append(read[:READ_LENGTH])
                        keys.append(_seed(seed, "quality", name, n, strand, k))
            yield _fastq(model, ids, texts, np.array(keys, np.uint64))

    return pieces.where(F.length("fragment") >= MIN_FRAGMENT).select("name", "n", "fragment", "left_site", "right_site").mapInPandas(one, "id string, seq string, qual string")


def _turned(text: str) -> str:
    return text[::-1].translate(str.maketrans("ACGTNacgtn", "TGCANtgcan"))


def _fastq(model: QualityChain, ids: list[str], texts: list[str], keys: np.ndarray) -> pd.DataFrame:
    n, none = len(ids), model.moves.shape[2]
    if not n:
        return pd.DataFrame({"id": [], "seq": [], "qual": []}, dtype=str)
    bases = np.full((n, READ_LENGTH), ord("N"), np.uint8)
    for i, text in enumerate(texts):
        bases[i, : len(text)] = np.frombuffer(text.encode(), np.uint8)
    inside = np.arange(READ_LENGTH)[None] < np.array([len(t) for t in texts])[:, None]
    going, lost, draw = (_uniform(keys, s, READ_LENGTH) for s in (1, 2, 3))
    quality = np.full((n, READ_LENGTH), ord(MISSING_QUALITY), np.uint8)
    before, gone = np.full(n, none), np.zeros(n, bool)
    for b in range(READ_LENGTH):
        begins = lost[:, b] < model.missing[b]
        gone = (gone & (going[:, b] < model.missing_on[b])) | begins
        before = np.where(gone, none, np.minimum((model.moves[b, before] <= draw[:, b, None]).sum(axis=1), none - 1))
        use = ~gone & inside[:, b]
        quality[use, b] = before[use] + 33
        bases[gone, b] = ord("N")
    return pd.DataFrame({"id": ids, "seq": [x.tobytes().decode() for x in bases], "qual": [x.tobytes().decode() for x in quality]})


def _with_errors(rng: np.random.Generator, text: str) -> tuple[str, tuple[int, int, int]]:
    """The text with errors, and how many of them were wrong, extra and lost stretches."""
    out, at, counts = [], 0, [0, 0, 0]
    # only the places of errors are drawn
    while at < len(text):
        skip = int(rng.geometric(ERROR_RATE)) - 1
        out.append(text[at : at + skip])
        at += skip
        if at >= len(text):
            break
        kind = int(rng.integers(3))
        counts[kind] += 1
        if kind == 0:
            out.append(WRONG[text[at].upper()][int(np.searchsorted((0.6, 0.8), rng.random(), side="right"))] if text[at].upper() in WRONG else text[at])
            at += 1
        else:
            n = max(1, int(np.ceil(rng.exponential(1 / INDEL_RATE))))
            if kind == 1:
                out.append("".join(BASES[i] for i in rng.integers(4, size=n)))
            else:
                at += n
    return "".join(out), tuple(counts)


def fastq_lines(records: DataFrame) -> DataFrame:
    return records.select(F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value"))


def key_file(samples: DataFrame, flowcell: str, lane: str, enzyme: str, plate: str = "plate1", prep: str = "prep", genus: str = "", species: str = "") -> DataFrame:
    """Sample sheet of nineteen columns. ``samples``: ix from 0, sample, barcode, parent (whether it is one)."""
    from loomspan.functions.scalar import padded, well

    place, column = well(F.col("ix")), padded(F.col("ix") % 12 + 1, 2)
    pedigree = F.when(F.col("parent"), "NA").otherwise("P1xP2")
    values = {
        "Flowcell": F.lit(flowcell), "Lane": F.lit(lane), "Barcode": F.col("barcode"), "DNASample": F.col("sample"), "LibraryPlate": F.lit(plate), "Row": F.substring(place, 1, 1), "Col": (F.col("ix") % 12 + 1).cast("string"),
        "LibraryPrepID": F.concat(F.lit(prep), column), "LibraryPlateID": F.lit(plate), "Enzyme": F.lit(enzyme), "BarcodeWell": place, "DNA_Plate": F.lit(plate), "SampleDNA_Well": place, "Genus": F.lit(genus), "Species": F.lit(species),
        "Pedigree": pedigree, "Population": pedigree, "SeedLot": F.lit(""), "FullSampleName": F.concat_ws(":", "sample", F.lit(flowcell), F.lit(lane), F.concat(F.lit(prep), column)),
    }
    return samples.select(*[v.alias(k) for k, v in values.items()])


def genomes(sequences: DataFrame, truth: DataFrame) -> DataFrame:
    """sample, haplotype (from 1), name, seq: each individual's copies of the reference (name, seq) with its alleles in place.

    One task a chromosome and sample; a chromosome's sequence is its unit of work.
    """
    rows = truth.groupBy("chrom", "sample").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", "alleles"))).alias("m"))
    units = rows.join(sequences.select(F.col("name").alias("chrom"), "seq"), "chrom").repartition("chrom", "sample")

    def one(batches):
        for pdf in batches:
            out = []
            for chrom, sample, m, seq in zip(pdf.chrom, pdf["sample"], pdf.m, pdf.seq, strict=True):
                for h in range(len(m[0]["alleles"])):
                    letters = bytearray(seq.encode())
                    for x in m:
                        if x["pos"] <= len(letters):
                            letters[x["pos"] - 1] = ord(x["alt"] if x["alleles"][h] else x["ref"])
                    out.append((sample, h + 1, chrom, letters.decode()))
            yield pd.DataFrame(out, columns=["sample", "haplotype", "name", "seq"])

    return units.mapInPandas(one, "sample string, haplotype int, name string, seq string")


def pedigree_lines(family: DataFrame) -> DataFrame:
    """Name and parents of each individual; founders have NA."""
    parent = lambda p: F.when(F.col("role") < 2, "NA").otherwise(p)
    rows = family.select("sample_ix", F.concat_ws("\t", "sample", parent("P1"), parent("P2")).alias("value"))
    return _headed(rows, "Name\tParent1\tParent2", "sample_ix")


def chromosome_lines(chromosomes: DataFrame, centromere: float = 0.4) -> DataFrame:
    """Genetic length in centimorgans at 1 cM a million base pairs, and the centromere's place."""
    cm = F.col("length") / (MORGAN_BP / 100)
    rows = chromosomes.select("chrom", F.concat_ws("\t", "chrom", F.format_number(cm, 6), F.format_number(cm * centromere, 6)).alias("value"))
    return _headed(rows, "chromosome\tlength\tcentromere", "chrom")


def marker_lines(sites: DataFrame) -> DataFrame:
    """Map positions in centimorgans."""
    rows = sites.select("chrom", "pos", F.concat_ws("\t", F.concat_ws("_", "chrom", F.col("pos").cast("string")), "chrom", F.format_number(F.col("pos") / (MORGAN_BP / 100), 6)).alias("value"))
    return _headed(rows, "marker\tchromosome\tposition", "chrom", "pos")


def founder_lines(sites: DataFrame) -> DataFrame:
    rows = sites.select("chrom", "pos", F.concat_ws("\t", F.concat_ws("_", "chrom", F.col("pos").cast("string")), F.array_join(F.transform("founders", lambda x: x.cast("string")), "\t")).alias("value"))
    return _headed(rows, "marker", "chrom", "pos")


def _headed(rows: DataFrame, head: str, *order: str) -> DataFrame:
    first = rows.sparkSession.range(1).select(F.lit(0).alias("_n"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in order], F.lit(head).alias("value"))
    return first.union(rows.select(F.lit(1).alias("_n"), *order, "value")).orderBy("_n", *order).select("value")
