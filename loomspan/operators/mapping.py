"""Linkage operators on edge lists: marker paths, superscaffolds, groups, chimeras, order, map assembly."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import scalar as X
from loomspan.operators import windows as W
from loomspan.operators.grouping import connected_components
from loomspan.operators.kernels import linkage
from loomspan.operators.numbering import global_index

RF = [f"rf_{o}" for o in ("ss", "se", "es", "ee")]
#: Fractions up to which ends are joined, and contigs are grouped: half of tanh(0.6) and tanh(1).
JOIN_RF, GROUP_RF = 0.2685247835, 0.3808
#: Distance in centimorgans at which an edge weighs nothing.
FAR_CM = 300.0


def marker_paths(pairs: DataFrame) -> DataFrame:
    """contig, ord, u, v, rf, bp: edges of the lightest path over each contig's marker pairs (u, v, rf, bp, m)."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        edges = {(int(u), int(v)): (float(r), float(b)) for u, v, r, b in zip(pdf.u, pdf.v, pdf.rf, pdf.bp, strict=True)}
        path, _ = linkage.shortest_path(int(pdf.m.iloc[0]), [(u, v, float(linkage.kosambi(r))) for (u, v), (r, _) in edges.items()])
        rows = [(key[0], i, u, v, *edges[u, v]) for i, (u, v) in enumerate(zip(path, path[1:], strict=False))]
        return pd.DataFrame(rows, columns=["contig", "ord", "u", "v", "rf", "bp"])

    return pairs.groupBy("contig").applyInPandas(one, "contig string, ord int, u int, v int, rf double, bp double")


def superscaffolds(pairs: DataFrame, contigs: DataFrame, threshold: float = JOIN_RF) -> DataFrame:
    """cluster, ord, contig, reversed, gap_rf. Contigs that no fraction up to the threshold connects can't be joined, so
    each connected component of those edges is one task; a contig without edges is a cluster of its own."""
    near = pairs.where(F.least(*RF) <= threshold)
    labels = connected_components(near.select("a", "b"))
    inside = near.join(labels.select(F.col("v").alias("a"), "label"), "a").join(labels.select(F.col("v").alias("b"), F.col("label").alias("other")), "b").where("label = other")

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.a, *pdf.b})
        rows = [(a, b, four) for a, b, *four in pdf[["a", "b", *RF]].itertuples(index=False)]
        out = []
        for chain in linkage.join_ends(names, [(a, b, tuple(f)) for a, b, f in rows], threshold):
            out += [(chain[0][0], i, c, r, g) for i, (c, r, g) in enumerate(chain)]
        return pd.DataFrame(out, columns=["cluster", "ord", "contig", "reversed", "gap_rf"])

    joined = inside.select("label", "a", "b", *RF).groupBy("label").applyInPandas(one, "cluster string, ord int, contig string, reversed boolean, gap_rf double")
    alone = contigs.select("contig").join(joined.select("contig"), "contig", "left_anti")
    return joined.union(alone.select(F.col("contig").alias("cluster"), F.lit(0).alias("ord"), "contig", F.lit(False).alias("reversed"), F.lit(None).cast("double").alias("gap_rf")))


def linkage_groups(pairs: DataFrame, contigs: DataFrame, max_rf: float = GROUP_RF, min_lod: float = 3.0, one_group: bool = False) -> DataFrame:
    """contig, lg (1 for the largest): groups by weight FAR_CM - cM of the edges that pass, split by modularity within
    each connected component. Contigs without edges are groups of one."""
    if one_group:
        return contigs.select("contig", F.lit(1).cast("long").alias("lg"))
    kept = pairs.where((F.col("rf_min") <= max_rf) & (F.col("lod") >= min_lod)).withColumn("w", FAR_CM - X.centimorgan(F.col("rf_min")))
    labels = connected_components(kept.select("a", "b"))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = linkage.communities(sorted({*pdf.a, *pdf.b}), list(zip(pdf.a, pdf.b, pdf.w, strict=True)))
        return pd.DataFrame(sorted(found.items()), columns=["contig", "name"])

    split = kept.join(labels.withColumnRenamed("v", "a"), "a").groupBy("label").applyInPandas(one, "contig string, name string")
    alone = contigs.select("contig").join(split.select("contig"), "contig", "left_anti").select("contig", F.col("contig").alias("name"))
    groups = split.union(alone)
    sizes = groups.groupBy("name").agg(F.count("*").alias("n"), F.min("contig").alias("first"))
    ranked = global_index(sizes, [F.desc("n"), "first"], "lg").withColumn("lg", F.col("lg") + 1)
    return groups.join(ranked.select("name", "lg"), "name").select("contig", "lg")


def nearest_in_group(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """contig, least: the least fraction to the rest of its group. Without ``groups`` all pairs are inside one."""
    if groups is not None:
        pairs = pairs.join(groups.select(F.col("contig").alias("a"), "lg"), "a").join(groups.select(F.col("contig").alias("b"), F.col("lg").alias("other")), "b").where("lg = other")
    return pairs.select(F.explode(F.array("a", "b")).alias("contig"), "rf_min").groupBy("contig").agg(F.min("rf_min").alias("least"))


def chimeras(pairs: DataFrame, groups: DataFrame | None, max_rf: float) -> DataFrame:
    """Contigs whose least fraction to the rest of their group is above ``max_rf``."""
    return nearest_in_group(pairs, groups).where(F.col("least") > max_rf)


def ordered_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """lg, ord, contig, reversed, cm: the shortest walk through each group (cm: to the next contig)."""
    inside = pairs.join(groups.select(F.col("contig").alias("a"), "lg"), "a").join(groups.select(F.col("contig").alias("b"), F.col("lg").alias("other")), "b").where("lg = other")
    lod = F.col("lod") if "lod" in pairs.columns else F.lit(None).cast("double")
    rows = inside.select("lg", "a", "b", *RF, lod.alias("lod")).union(groups.select("lg", F.col("contig").alias("a"), F.col("contig").alias("b"), *[F.lit(0.0).alias(r) for r in RF], F.lit(None).cast("double")))

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rf = {(a, b): tuple(four) for a, b, *four in pdf[["a", "b", *RF]].itertuples(index=False) if a != b}
        scores = {(a, b): float(x) for a, b, x in zip(pdf.a, pdf.b, pdf.lod, strict=True) if a != b and x == x}
        walk = linkage.order(sorted({*pdf.a, *pdf.b}), rf, scores=scores)
        return pd.DataFrame([(key[0], i, c, r, g) for i, (c, r, g) in enumerate(walk)], columns=["lg", "ord", "contig", "reversed", "cm"])

    return rows.groupBy("lg").applyInPandas(one, "lg long, ord int, contig string, reversed boolean, cm double")


def assembled_map(ordered: DataFrame, lengths: DataFrame) -> DataFrame:
    """Linkage map rows (lg, ord, contig, strand, cm_start, cm_end): own lengths (contig, own_cm) and the walk's gaps add up."""
    rows = ordered.join(lengths, "contig", "left").withColumn("own_cm", F.coalesce("own_cm", F.lit(0.0)))
    rows = W.running_offset(rows, ["lg"], ["ord"], F.col("own_cm") + F.col("cm"))
    return rows.select("lg", "ord", "contig", F.when(F.col("reversed"), "-").otherwise("+").alias("strand"), F.col("offset").alias("cm_start"), (F.col("offset") + F.col("own_cm")).alias("cm_end"))


def contig_lengths(maps: DataFrame) -> DataFrame:
    """(contig, own_cm) of contig maps (contig, rf array)."""
    return maps.select("contig", F.explode("rf").alias("r")).groupBy("contig").agg(F.sum(X.centimorgan(F.col("r"))).alias("own_cm"))


def neighbour_scaffolds(pairs: DataFrame, neighbours: int = 3) -> DataFrame:
    """cluster, ord, contig, reversed, cm: each contig with its nearest ones (ties included), clusters inside another gone,
    the rest in the order of their shortest walk. A contig can be in several clusters."""
    from loomspan.operators.joins import subsets_removed

    both = pairs.select("a", "b", "rf_min").union(pairs.select("b", "a", "rf_min"))
    near = W.with_ties(both, ["a"], F.col("rf_min"), neighbours).select("a", "b")
    sets = near.union(near.select("a", F.col("a").alias("b"))).distinct()
    kept = sets.join(subsets_removed(sets, "a", "b").select("a"), "a", "left_semi").select(F.col("a").alias("cluster"), F.col("b").alias("contig"))
    ids = global_index(kept.select("cluster").distinct(), ["cluster"], "lg").withColumn("lg", F.col("lg") + 1)
    ordered = ordered_groups(pairs, kept.join(ids, "cluster").select("contig", "lg"))
    return ordered.join(ids, "lg").select("cluster", "ord", "contig", "reversed", "cm")


def pseudomolecules(linkage_map: DataFrame, sequences: DataFrame, errors: DataFrame | None = None, gap: int = 1000, trim_gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    """(object, seq) and parts for AGP. Contigs with errors are cut at them first: the stretch between the two markers of an
    error goes, or, with ``trim_gaps``, only the run of N in it if it has one."""
    from loomspan.sources.sequences import assemble

    seqs = sequences.select(F.col("name").alias("contig"), "seq")
    if errors is not None:
        cut = errors.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct(F.col("left").cast("long").alias("l"), F.col("right").cast("long").alias("r")))).alias("e"))
        held = seqs.join(cut, "contig")
        bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform("e", lambda x: x["r"] - 1)), F.concat(F.transform("e", lambda x: x["l"]), F.array(F.length("seq").cast("long")))
        if trim_gaps:
            def hole(x):
                between = F.substring(F.col("seq"), (x["l"] + 1).cast("int"), F.greatest(x["r"] - x["l"] - 1, F.lit(0)).cast("int"))
                return F.regexp_instr(between, F.lit("[Nn]+")), F.length(F.regexp_extract(between, "([Nn]+)", 1))

            starts = F.transform("e", lambda x: F.when(hole(x)[0] > 0, x["l"] + hole(x)[0] - 1 + hole(x)[1]).otherwise(x["r"] - 1))
            stops = F.transform("e", lambda x: F.when(hole(x)[0] > 0, x["l"] + hole(x)[0] - 1).otherwise(x["l"]))
            bounds = F.concat(F.array(F.lit(0).cast("long")), starts), F.concat(stops, F.array(F.length("seq").cast("long")))
        parts = held.select("contig", "seq", F.posexplode(F.arrays_zip(bounds[0].alias("b"), bounds[1].alias("s"))).alias("n", "z"))
        broken = parts.select(F.concat_ws("_", "contig", (F.col("n") + 1).cast("string")).alias("contig"), F.substring(F.col("seq"), (F.col("z.b") + 1).cast("int"), F.greatest(F.col("z.s") - F.col("z.b"), F.lit(0)).cast("int")).alias("seq"))
        seqs = seqs.join(cut.select("contig"), "contig", "left_anti").union(broken)
    rows = linkage_map.join(seqs, "contig").select(F.concat(F.lit("LG"), F.lpad(F.col("lg").cast("string"), 2, "0")).alias("object"), F.col("ord"), F.col("contig").alias("component"), "strand", "seq", F.length("seq").alias("length"))
    return assemble(rows, gap), rows.drop("seq")
