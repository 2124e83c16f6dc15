"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op5_ann as o5
from . import op10_toxicity as o10
from . import op11_centroids as o11
from . import op12_align as o12
from . import op13_exact_dedup as o13
from . import op1_html as o1
from . import op2_line_dedup as o2
from . import op3_suffix_dedup as o3
from . import op4_mix as o4
from . import op6_quality as o6
from . import op7_simhash as o7
from . import op8_decontaminate as o8
from . import op9_tokens as o9

QUERIES = {
    "op1_html": o1.op1_html,
    "op2_line_dedup": o2.op2_line_dedup,
    "op3_suffix_dedup": o3.op3_suffix_dedup,
    "op4_mix": o4.op4_mix,
    "op5_ann": o5.op5_ann,
    "op6_quality": o6.op6_quality,
    "op7_simhash": o7.op7_simhash,
    "op8_decontaminate": o8.op8_decontaminate,
    "op9_tokens": o9.op9_tokens,
    "op10_toxicity": o10.op10_toxicity,
    "op11_centroids": o11.op11_centroids,
    "op12_align": o12.op12_align,
    "op13_exact_dedup": o13.op13_exact_dedup,
}
SQL = {"op2_line_dedup": o2.SQL, "op8_decontaminate": o8.SQL, "op11_centroids": o11.SQL, "op13_exact_dedup": o13.SQL}
