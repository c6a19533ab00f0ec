"""The queries of the training-data operators."""

from tessera.llm.chat_format import OP1_SQL, op1_chat_format
from tessera.llm.decontaminate import op5_decontaminate
from tessera.llm.language_model import op2_language_model
from tessera.llm.packing import op3_packing
from tessera.llm.quality_model import op9_quality_model
from tessera.llm.quality_rules import OP10_SQL, op10_quality_rules
from tessera.llm.simhash import op7_simhash
from tessera.llm.suffix_dedup import op8_suffix_dedup
from tessera.llm.token_files import op6_token_files
from tessera.llm.url_filter import OP4_SQL, op4_url_filter

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_language_model, op3_packing, op4_url_filter, op5_decontaminate, op6_token_files, op7_simhash, op8_suffix_dedup, op9_quality_model, op10_quality_rules)}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op4_url_filter": OP4_SQL, "op10_quality_rules": OP10_SQL}
