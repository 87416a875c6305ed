"""The registered queries of this subpackage and the SQL to hold them against."""

from __future__ import annotations

from . import centroids, codes
from .bytepair import op12_bytepair
from .centroids import op11_centroids
from .codes import op13_codes
from .jaccard import op2_jaccard
from .language import op1_language
from .licenses import op6_licenses
from .mixing import op4_mixing
from .neighbours import op3_neighbours
from .packing import op9_packing
from .pii import op5_pii
from .quality import op7_quality
from .substrings import op10_substrings
from .toxicity import op8_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_jaccard": op2_jaccard,
    "op3_neighbours": op3_neighbours,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_substrings": op10_substrings,
    "op11_centroids": op11_centroids,
    "op12_bytepair": op12_bytepair,
    "op13_codes": op13_codes,
}

ORACLE: dict[str, str] = {"op11_centroids": centroids.SQL, "op13_codes": codes.SQL}
