"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from gneiss.llm.bpe import op1_bpe
from gneiss.llm.embeddings import OP9_SQL, op9_embeddings
from gneiss.llm.languages import op6_languages
from gneiss.llm.lines import OP4_SQL, op4_lines
from gneiss.llm.packing import op8_packing
from gneiss.llm.quality import OP5_SQL, op5_quality
from gneiss.llm.simhash import op10_simhash
from gneiss.llm.substrings import OP2_SQL, op2_substrings
from gneiss.llm.urls import OP7_SQL, op7_urls
from gneiss.llm.warc import OP3_SQL, op3_warc

QUERIES = {f.__name__: f for f in (op1_bpe, op2_substrings, op3_warc, op4_lines, op5_quality, op6_languages, op7_urls, op8_packing, op9_embeddings, op10_simhash)}

ORACLE_SQL: dict[str, str] = {"op2_substrings": OP2_SQL, "op3_warc": OP3_SQL, "op4_lines": OP4_SQL, "op5_quality": OP5_SQL, "op7_urls": OP7_SQL, "op9_embeddings": OP9_SQL}
