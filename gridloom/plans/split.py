"""Queries that find and split regions in which two patterns have grown together. Regions are those of the grown mask."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import merge as M
from ..operators import split as P
from . import adapters as A
from .adapters import H, W
from .merge import _AXES, _SHAPED, _SUMS, _WIDE
from .segments import _TURN

#: The given maps are spread evenly, so that no ring holds what a real one does: a tenth of a region's cells near the peak is asked for here.
_C, _R = P.SUSPECT, {**P.RING, "least": 2, "ring_share": 0.10}
_SUSPECT = f"""{_WIDE}, ts as (select map_id, token, {_SUMS} from lab join edge using (map_id, r, c) group by 1, 2), t1 as ({_SHAPED} from ts), t2 as ({_AXES} from t1),
 sp as (select *, cast(greatest((r1 - r0 + 1) / cast(c1 - c0 + 1 as double), (c1 - c0 + 1) / cast(r1 - r0 + 1 as double)) >= {_C['aspect']} as int) + cast(round(l1 / greatest(l2, 1e-6), 9) >= {_C['elongation']} as int)
 + cast(perimeter / cast(area as double) >= {_C['compactness']} as int) + cast(area / cast((r1 - r0 + 1) * (c1 - c0 + 1) as double) <= {_C['fill']} as int) as cues from t2)"""


@query("g19_suspicious_regions", f"{_SUSPECT} select map_id, cast(token as bigint) as token, area, cast(cues as bigint) as cues from sp where area >= {_C['area']} and cues >= {_C['cues']}")
def suspicious_regions(spark, sf_dir):
    """Regions that are large and look like two patterns in one."""
    own = P.suspicious(M.with_shape(M.token_sums(M.dilated_cells(A.maps(spark, sf_dir), H, W)), H, W))
    return own.select("map_id", F.col("token").cast("bigint").alias("token"), "area", F.col("cues").cast("bigint").alias("cues"))


@query("g20_ring_split", f"""{_SUSPECT}, pts as (select lab.map_id, lab.token, lab.r, lab.c, sqrt((r - 8) * (r - 8) + (c - 8) * (c - 8)) / {A.RADIUS!r} as d, cast(floor({_TURN} / 10.0) as int) as sector from lab join sp using (map_id, token) where sp.area >= {_C['area']} and cues >= {_C['cues']}),
 bn as (select map_id, token, least(cast(floor(round(d / {_R['reach'] / _R['bins']!r}, 9)) as int), 27) as bin, count(*) as n from pts group by 1, 2, 3), pk as (select map_id, token, bin, n as peak, row_number() over (partition by map_id, token order by n desc, bin) as k from bn),
 rg as (select pts.*, peak, round(abs(d - (bin + 0.5) * {_R['reach'] / _R['bins']!r}), 9) <= {_R['half_width']} as ring from pts join pk using (map_id, token) where k = 1),
 sm as (select map_id, token, count(*) as n, any_value(peak) as peak, count(*) filter (ring) as in_ring, count(distinct sector) filter (ring) as sectors from rg group by 1, 2),
 ok as (select * from sm where n >= {_R['area']} and peak >= greatest({2 * _R['least']}, n * {_R['ring_share']}) and in_ring >= greatest({_R['least']}, n * {_R['ring_share']}) and n - in_ring >= greatest({_R['least']}, n * {_R['rest_share']}) and sectors / 36.0 >= {_R['coverage']}),
 rs as (select rg.map_id, rg.token, r, c from rg join ok using (map_id, token) where not ring),
 walk(map_id, token, r, c, label) as (select map_id, token, r, c, r * 16 + c + 1 from rs union select walk.map_id, walk.token, b.r, b.c, walk.label from walk join rs b on b.map_id = walk.map_id and b.token = walk.token and abs(b.r - walk.r) <= 1 and abs(b.c - walk.c) <= 1),
 pt as (select map_id, token, part, count(*) as area from (select map_id, token, r, c, min(label) as part from walk group by 1, 2, 3, 4) group by 1, 2, 3 having count(*) >= {_R['least']} union all select map_id, token, 0, in_ring from ok),
 al as (select pt.*, count(*) over (partition by map_id, token) as parts, sum(area) over (partition by map_id, token) as kept from pt)
 select al.map_id, cast(al.token as bigint) as token, cast(part as bigint) as part, area from al join ok using (map_id, token) where parts > 1 and parts <= 6 and kept >= 0.75 * n""")
def ring_split(spark, sf_dir):
    """The ring and the rest of suspicious regions that have both."""
    own = P.split_suspicious(M.dilated_cells(A.maps(spark, sf_dir), H, W), H, W, A.RADIUS, _R)
    return own.select("map_id", *[F.col(x).cast("bigint").alias(x) for x in ("token", "part", "area")])
