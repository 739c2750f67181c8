"""Maps on which a rule's value is exactly at its bound, or a token has no axis: Spark and SQL decide the same."""

import duckdb
import pytest

from gridloom import catalog

from .oracle import compare

#: Cells of maps (row * 16 + column, x and count if more than one).
CELLS = {
    4623: "5 6 7x3 25 39 42 43 44 45 52 60 61 62 68 75 85x2 88 93 95 99 101 103 107 109 111 112 116 117 118 122 127 131 134x2 137 157 166 168 170 172 174 177 184 185 188 194 211 217 221 227x2 229 230 233 250",
    477: "9 19x2 20 22 27 37 39 43 49 54 56 59 74 75 77 83 86 98 99 100 102 110 111x2 112x2 115 119 121 126 145 150 157 158 164 166 169x2 171 173 181 187 200 219 221 227 229 230 232",
    3066: "8 24 25 34 40 41 51 53 57 59 62 65 68x2 75 85 86 89x2 91 94 99 105x2 118 124 131 134 136 139 143 146 147x2 152 153x2 154 155 167 168 171x2 181x2 182 190 194 197 205x2 212 217 218 235",
    3700: "10 21x2 24 39 44 50 61 62 65 71 72 83 100 101 102 106 108 112 114x2 120 125x2 127x2 129 130 136 137 142 149 150 160 165 171 173 184 185 188 193 200 228 232x2",
}


@pytest.mark.parametrize("name", ["g11_diverse_tokens", "g8_component_kinds", "g23_geometry_merge", "g23_merge_edges"])
def test_values_at_their_bounds(spark, tmp_path, name):
    rows = [(m, *divmod(int(cell.split("x")[0]), 16)) for m, cells in CELLS.items() for cell in cells.split() for _ in range(int((cell + "x1").split("x")[1]))]
    con = duckdb.connect()
    con.execute("create table lineitem as select m::bigint as l_suppkey, r::bigint as l_partkey, c::bigint as l_orderkey, 50.0::double as l_quantity from (values " + ", ".join(map(str, rows)) + ") t(m, r, c)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet'")
    assert compare(spark, str(tmp_path), catalog.queries()[name], catalog.oracle_sql()[name], con) == ""
