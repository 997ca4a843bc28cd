"""The registered queries on texts and their DuckDB SQL."""

from barley.llm.collocations import OP12_SQL, op12_phrase_collocations
from barley.llm.decontamination import OP7_SQL, op7_benchmark_decontamination
from barley.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from barley.llm.license_scan import OP10_SQL, op10_license_scans
from barley.llm.ngram_join import OP2_SQL, op2_ngram_jaccard_join
from barley.llm.packing import op6_best_fit_packing
from barley.llm.pii import op3_pii
from barley.llm.prefix_trie import OP11_SQL, op11_conversation_prefix_trie
from barley.llm.quality_rules import OP5_SQL, op5_quality_rules
from barley.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from barley.llm.token_counts import op9_token_counts
from barley.llm.toxicity import op8_toxicity
from barley.llm.url_rules import OP4_SQL, op4_url_filters

QUERIES = {q.__name__: q for q in (
    op1_substring_dedup, op2_ngram_jaccard_join, op3_pii, op4_url_filters, op5_quality_rules, op6_best_fit_packing, op7_benchmark_decontamination,
    op8_toxicity, op9_token_counts, op10_license_scans, op11_conversation_prefix_trie, op12_phrase_collocations, op13_exact_dedup)}

SQL = {"op1_substring_dedup": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op4_url_filters": OP4_SQL, "op5_quality_rules": OP5_SQL,
       "op7_benchmark_decontamination": OP7_SQL, "op10_license_scans": OP10_SQL, "op11_conversation_prefix_trie": OP11_SQL, "op12_phrase_collocations": OP12_SQL, "op13_exact_dedup": OP13_SQL}
