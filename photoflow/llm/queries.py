"""The registered queries of this subpackage and their DuckDB SQL."""

from photoflow.llm.chat import OP8_SQL, op8_chat_formatting
from photoflow.llm.image_match import op7_image_match
from photoflow.llm.license_scan import op6_license_scan
from photoflow.llm.line_dedup import op3_line_dedup
from photoflow.llm.ngram_join import OP10_SQL, op10_ngram_jaccard
from photoflow.llm.packing import op9_best_fit_packing
from photoflow.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from photoflow.llm.piece_lattice import op4_sentencepiece
from photoflow.llm.quality_rules import op5_quality_rules
from photoflow.llm.ranked_search import OP11_SQL, op11_ranked_search
from photoflow.llm.toxicity import op2_toxicity
from photoflow.llm.url_filter import OP1_SQL, URL_ALIASES_SQL, op1_url_filter, url_aliases
from photoflow.llm.warc import OP12_SQL, op12_warc_revisits

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_image_match": op7_image_match,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_ranked_search": op11_ranked_search,
    "op12_warc_revisits": op12_warc_revisits,
    "op13_periodic_runs": op13_periodic_runs,
    "url_aliases": url_aliases,
}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": OP1_SQL, "op8_chat_formatting": OP8_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_ranked_search": OP11_SQL, "op12_warc_revisits": OP12_SQL, "op13_periodic_runs": OP13_SQL, "url_aliases": URL_ALIASES_SQL}
