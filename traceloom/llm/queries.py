"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from traceloom.llm import op1_lines, op6_decontamination
from traceloom.llm.op1_lines import op1_line_dedup
from traceloom.llm.op2_licenses import op2_licenses
from traceloom.llm.op3_near_duplicates import op3_near_duplicates
from traceloom.llm.op4_sharding import op4_sharding
from traceloom.llm.op5_packing import op5_packing
from traceloom.llm.op6_decontamination import op6_decontamination as op6
from traceloom.llm.op7_language import op7_language
from traceloom.llm.op8_records import op8_token_records
from traceloom.llm.op9_audio import op9_audio
from traceloom.llm.op10_suffixes import op10_suffix_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_licenses": op2_licenses,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_decontamination": op6,
    "op7_language": op7_language,
    "op8_token_records": op8_token_records,
    "op9_audio": op9_audio,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES = {"op1_line_dedup": op1_lines.ORACLE, "op6_decontamination": op6_decontamination.ORACLE}
