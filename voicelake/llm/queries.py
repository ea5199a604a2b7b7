"""The operators' registered queries and their SQL."""

from voicelake.llm.bpe import op3_bpe
from voicelake.llm.chat import OP4_SQL, op4_preferences
from voicelake.llm.convtrie import OP12_SQL, op12_trie
from voicelake.llm.fingerprint import op2_fingerprints
from voicelake.llm.mixing import OP1_SQL, op1_mix
from voicelake.llm.neardup import op9_neardup
from voicelake.llm.phrases import OP11_SQL, op11_phrases
from voicelake.llm.pii import op13_private
from voicelake.llm.quality import op6_quality
from voicelake.llm.sharding import op5_shards
from voicelake.llm.suffixdedup import op7_repeats
from voicelake.llm.toxicity import op8_toxicity
from voicelake.llm.warc import OP10_SQL, op10_derivatives

QUERIES = {
    "op1_mix": op1_mix,
    "op2_fingerprints": op2_fingerprints,
    "op3_bpe": op3_bpe,
    "op4_preferences": op4_preferences,
    "op5_shards": op5_shards,
    "op6_quality": op6_quality,
    "op7_repeats": op7_repeats,
    "op8_toxicity": op8_toxicity,
    "op9_neardup": op9_neardup,
    "op10_derivatives": op10_derivatives,
    "op11_phrases": op11_phrases,
    "op12_trie": op12_trie,
    "op13_private": op13_private,
}
#: The others hash with functions that SQL engines do not share, or iterate; tests hold them against plain versions.
SQL = {"op1_mix": OP1_SQL, "op4_preferences": OP4_SQL, "op10_derivatives": OP10_SQL, "op11_phrases": OP11_SQL, "op12_trie": OP12_SQL}
