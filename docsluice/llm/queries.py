"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .html_text import op5_html_text
from .language_model import op3_masked_lm
from .lexical import OP11_SQL, op11_ranked_search
from .media import op7_media
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP6_SQL, op6_mixing
from .ngram_join import OP1_SQL, op1_ngram_jaccard_join
from .quality import op9_quality
from .simhash import op13_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .toxicity import op10_toxicity
from .vector_search import op8_vector_search

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_masked_lm": op3_masked_lm,
    "op4_bpe": op4_bpe,
    "op5_html_text": op5_html_text,
    "op6_mixing": op6_mixing,
    "op7_media": op7_media,
    "op8_vector_search": op8_vector_search,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash": op13_simhash,
}
#: The others have no SQL: their models, tokenizer, media files and parsers are tested in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_ngram_jaccard_join": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op6_mixing": OP6_SQL, "op11_ranked_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
