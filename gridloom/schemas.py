"""Table schemas, and checks that name what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The eight pattern classes of mixed maps, in label order.
CLASSES = ("Center", "Donut", "Edge-Loc", "Edge-Ring", "Loc", "Near-full", "Scratch", "Random")
LABELS = [f"label_{k}" for k in range(len(CLASSES))]


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "pixels": T.ArrayType(T.StructType([T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType())]))}


def _struct(text: str) -> T.StructType:
    """A schema from "name type, name type", without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(", "))])


_LABEL_COLUMNS = ", ".join(f"{c} int" for c in LABELS)
SPLIT_MANIFEST = _struct(f"sample_id bigint, original_index bigint, valid_index bigint, split string, label_signature string, {_LABEL_COLUMNS}")
QUERY_MANIFEST = _struct(f"sample_id bigint, original_index bigint, valid_index bigint, label_signature string, {_LABEL_COLUMNS}")
CANDIDATE_MANIFEST = _struct("query_id bigint, candidate_id bigint, bucket string, jaccard double, query_signature string, candidate_signature string")
RANKINGS = _struct("query_id bigint, candidate_id bigint, similarity_score double, rank int")
PREFERENCES = _struct("query_id bigint, preferred_candidate_id bigint, less_preferred_candidate_id bigint, rule_type string, rule_group string")
DEFECTS = _struct("wafer_id string, defect_id double, xindex double, yindex double, xrel double, yrel double, classnumber double")
CP_ROWS = _struct("Lot_Id string, Wafer_Number string, Die_X string, Die_Y string, Pf string, Hardbin_Number string")
TOKENS = _struct(
    "map_id bigint, token int, area int, mass double, centroid_r double, centroid_c double, r_min int, c_min int, r_max int, c_max int, "
    "lambda_1 double, lambda_2 double, orientation double, perimeter int, compactness double, fill double, aspect double, radial double, radial_std double, "
    "coverage double, max_run double, max_gap double, sector_cv double, support_ratio double, mass_ratio double, peak double, kind string, pixels pixels"
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """`df`, or ValueError with the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
