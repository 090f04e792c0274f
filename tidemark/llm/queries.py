"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .audio import op7_audio
from .fingerprints import op3_fingerprints
from .langid import op8_langid
from .licenses import op10_licenses
from .line_dedup import op5_line_dedup
from .ngram_join import op1_ngram_join
from .packing import op4_packing
from .sentencepieces import op2_sentencepiece
from .suffix_dedup import op6_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_fingerprints": op3_fingerprints,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_audio": op7_audio,
    "op8_langid": op8_langid,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
}
ORACLES: dict[str, str] = {}
