"""Registered queries of the text operators, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from fleetspan.llm.bpe import op12_bpe
from fleetspan.llm.chat import op5_chat_format
from fleetspan.llm.decontaminate import op3_decontaminate
from fleetspan.llm.language_model import op2_language_model
from fleetspan.llm.licenses import op7_license_scan
from fleetspan.llm.line_dedup import op9_line_dedup
from fleetspan.llm.minhash import op1_near_duplicates
from fleetspan.llm.mixing import op8_mixing
from fleetspan.llm.quality_model import op6_quality_classifier
from fleetspan.llm.quality_rules import ORACLE as QUALITY_RULES
from fleetspan.llm.quality_rules import op10_quality_rules
from fleetspan.llm.repair import op13_conversation_repair
from fleetspan.llm.resample import ORACLE as RESAMPLE
from fleetspan.llm.resample import op11_importance_resample
from fleetspan.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language_model": op2_language_model,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resample": op11_importance_resample,
    "op12_bpe": op12_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}

SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op11_importance_resample": RESAMPLE,
    "op10_quality_rules": QUALITY_RULES,
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {SPACE}), {UPPER}, {LOWER}) AS k FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT doc_id, pos, line, coalesce(first_doc < doc_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
