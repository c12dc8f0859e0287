"""Spatial neighbours of sites: nodes within a radius, edges between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.vectors import AMINO_ACIDS

AXES = ("x", "y", "z")


def _cells(df: DataFrame, radius: float) -> DataFrame:
    return df.withColumns({f"_c{a}": F.floor(F.col(a) / F.lit(float(radius))) for a in AXES})


def _around(df: DataFrame, radius: float) -> DataFrame:
    """Each row in the 27 cells around its own."""
    out = _cells(df, radius)
    for a in AXES:
        out = out.withColumn(f"_c{a}", F.explode(F.array(*[F.col(f"_c{a}") + d for d in (-1, 0, 1)])))
    return out


def radius_nodes(
    sites: DataFrame, atoms: DataFrame, group: Sequence[str], site: Sequence[str], radius: float, max_nodes: int, order: str = "resseq"
) -> DataFrame:
    """The nearest ``max_nodes`` atoms within the radius of each site's centre (x, y, z).

    A site meets only the atoms of the 27 grid cells around it, by equi-join;
    each task keeps at most ``max_nodes`` rows of a site before the shuffle.
    """
    centres = _around(sites.select(*site, *[c for c in group if c not in site], *[F.col(a).alias(a) for a in AXES]), radius)
    centres = centres.withColumnsRenamed({a: f"_s{a}" for a in AXES})
    joined = centres.join(_cells(atoms, radius), [*group, *[f"_c{a}" for a in AXES]])
    square = sum(((F.col(a) - F.col(f"_s{a}")) * (F.col(a) - F.col(f"_s{a}")) for a in AXES[1:]),
                 (F.col("x") - F.col("_sx")) * (F.col("x") - F.col("_sx")))
    near = joined.withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    w = Window.partitionBy(*site).orderBy("distance", order)
    kept = near.withColumn("node_rank", F.row_number().over(w)).where(F.col("node_rank") <= max_nodes)
    return kept.drop(*[f"_c{a}" for a in AXES], *[f"_s{a}" for a in AXES])


def node_attributes(nodes: DataFrame, centre: str, aa: str = "aa", plddt: str = "plddt", order: str = "resseq") -> DataFrame:
    """One-hot residue, confidence / 100, scaled sequence offset and centre flag."""
    size = len(AMINO_ACIDS)
    at = F.instr(F.lit(AMINO_ACIDS), F.col(aa))
    index = F.when(at == 0, F.lit(size)).otherwise(at)
    return nodes.withColumns(
        {
            "one_hot": F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i == index).cast("float")),
            "confidence": F.col(plddt) / 100.0,
            "offset": (F.col(order) - F.col(centre)) / 50.0,
            "is_centre": (F.col(order) == F.col(centre)).cast("int"),
        }
    )


def node_edges(nodes: DataFrame, site: Sequence[str], radius: float, order: str = "resseq") -> DataFrame:
    """Ordered node pairs of a site within the radius or next to each other in the sequence.

    Nodes are numbered within their site by ``order``, then by x, y and z, so
    nodes that share a residue number keep their own edges: (site, source_node,
    target_node, source, target, scaled_distance, adjacent). Pairs come from two
    equi-joins, on neighbouring cells and on order +- 1. A site without any pair
    gets one loop on its first node.
    """
    keys = [*site]
    numbered = nodes.withColumn("_node", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *AXES)))
    left = numbered.select(*keys, F.col("_node").alias("source_node"), F.col(order).alias("source"), *AXES)
    right = numbered.select(*keys, F.col("_node").alias("target_node"), F.col(order).alias("target"), *[F.col(a).alias(f"_t{a}") for a in AXES])
    cells = [f"_c{a}" for a in AXES]
    targets = right.withColumns({f"_c{a}": F.floor(F.col(f"_t{a}") / F.lit(float(radius))) for a in AXES})
    by_space = _around(left, radius).join(targets, [*keys, *cells]).drop(*cells)
    steps = left.withColumn("target", F.explode(F.array(F.col("source") - 1, F.col("source") + 1)))
    by_order = steps.join(right, [*keys, "target"]).select(*by_space.columns)
    pairs = by_space.unionByName(by_order).where(F.col("source_node") != F.col("target_node")).dropDuplicates([*keys, "source_node", "target_node"])
    square = sum(((F.col(a) - F.col(f"_t{a}")) * (F.col(a) - F.col(f"_t{a}")) for a in AXES[1:]),
                 (F.col("x") - F.col("_tx")) * (F.col("x") - F.col("_tx")))
    measured = pairs.withColumn("distance", F.sqrt(square)).withColumn(
        "adjacent", (F.abs(F.col("source") - F.col("target")) == 1).cast("int")
    ).where((F.col("distance") <= radius) | (F.col("adjacent") == 1))
    edges = measured.select(*keys, "source_node", "target_node", "source", "target", (F.col("distance") / radius).alias("scaled_distance"), "adjacent")
    lonely = numbered.where("_node = 1").select(*keys, F.col(order).alias("source")).join(edges.select(*keys).distinct(), keys, "left_anti")
    one = F.lit(1)
    loops = lonely.select(*keys, one.alias("source_node"), one.alias("target_node"), "source", F.col("source").alias("target"), F.lit(0.0).alias("scaled_distance"), F.lit(0).alias("adjacent"))
    return edges.unionByName(loops)
