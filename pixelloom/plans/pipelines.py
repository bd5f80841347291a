"""Plans over pixel tables: the palette matrix, DCT dominant colour, segmentation. ``programs`` has fusion and impression colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import colour as C
from pixelloom.operators import background as B
from pixelloom.operators import clustering as K
from pixelloom.operators import frequency as Q
from pixelloom.operators import regions as R

PLANES = ("lab_l", "lab_a", "lab_b")


def palette_matrix(pixels: DataFrame, algorithms=K.ALGORITHMS, spaces=C.SPACES, k: int = 10, seed: int = 42) -> DataFrame:
    """Palettes of every image by every algorithm in every colour space."""
    out = None
    for a in algorithms:
        for s in spaces:
            p = K.palette(pixels, a, s, k, seed)
            out = p if out is None else out.unionByName(p)
    return out


def with_lab(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns(dict(zip(PLANES, C.lab(*C.unit("r", "g", "b")), strict=True)))


def dct_dominant(pixels: DataFrame, k: int = 10, positions: bool = False, sample: int | None = None) -> DataFrame:
    """Clusters by Lab and complexity (and position), scored by share and complexity."""
    m = B.sizes(Q.complexity_map(with_lab(pixels).withColumn("v", C.gray(*C.unit("r", "g", "b"))), "v"))
    m = m.withColumns({"fx": F.col("x") / F.col("w"), "fy": F.col("y") / F.col("h")})
    columns = [*PLANES, "complexity", *(("fx", "fy") if positions else ())]
    c = K.clusters_nd(m, columns, k, sample=sample)
    return K.dominant(c.join(m.select("image_id", "x", "y", "complexity"), ["image_id", "x", "y"]))


def segmented(pixels: DataFrame, p: R.SegmentParams = R.SegmentParams()) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels and region rows."""
    labelled = R.segment(pixels, p)
    return labelled, R.region_stats(labelled)
