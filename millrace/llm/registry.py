"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from millrace.llm.chat import OP13_SQL, op13_chat_formatting
from millrace.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from millrace.llm.fingerprints import op1_document_fingerprints
from millrace.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from millrace.llm.line_dedup import OP8_SQL, op8_line_dedup
from millrace.llm.mixing import op10_source_mixing
from millrace.llm.ngram_join import LINKS_SQL, OP6_SQL, ngram_jaccard_links, op6_ngram_jaccard_join
from millrace.llm.packing import op9_best_fit_packing
from millrace.llm.quality import op4_quality_classifier
from millrace.llm.tokens import op5_token_counts
from millrace.llm.toxicity import op7_toxicity
from millrace.llm.warc import OP3_SQL, op3_warc
from millrace.llm.whitening import op11_embedding_whitening

QUERIES: dict[str, Callable] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "ngram_jaccard_links": ngram_jaccard_links,
    "op7_toxicity": op7_toxicity,
    "op8_line_dedup": op8_line_dedup,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_source_mixing": op10_source_mixing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_formatting": op13_chat_formatting,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "ngram_jaccard_links": LINKS_SQL,
    "op8_line_dedup": OP8_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
