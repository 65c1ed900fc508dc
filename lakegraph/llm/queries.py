"""The queries of this subpackage by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from lakegraph.llm import op1_quality as op1
from lakegraph.llm import op2_bpe as op2
from lakegraph.llm import op3_language_id as op3
from lakegraph.llm import op4_line_dedup as op4
from lakegraph.llm import op5_personal_data as op5
from lakegraph.llm import op6_decontaminate as op6
from lakegraph.llm import op7_embedding_dedup as op7
from lakegraph.llm import op8_minhash_dedup as op8
from lakegraph.llm import op9_warc as op9
from lakegraph.llm import op10_url_filter as op10
from lakegraph.llm import op11_filter_audit as op11
from lakegraph.llm import op12_fill_in_middle as op12
from lakegraph.llm import op13_sentencepiece as op13

QUERIES = {
    "op1_quality": op1.op1_quality,
    "op2_bpe": op2.op2_bpe,
    "op3_language_id": op3.op3_language_id,
    "op4_line_dedup": op4.op4_line_dedup,
    "op5_personal_data": op5.op5_personal_data,
    "op6_decontaminate": op6.op6_decontaminate,
    "op7_embedding_dedup": op7.op7_embedding_dedup,
    "op8_minhash_dedup": op8.op8_minhash_dedup,
    "op9_warc": op9.op9_warc,
    "op10_url_filter": op10.op10_url_filter,
    "op11_filter_audit": op11.op11_filter_audit,
    "op12_fill_in_middle": op12.op12_fill_in_middle,
    "op13_sentencepiece": op13.op13_sentencepiece,
}
# Models, byte-pair merges, personal data with its added kinds and shingle similarity of all pairs have
# none; tests compare them with brute force or measure them on held-out rows.
SQL = {
    "op4_line_dedup": op4.SQL,
    "op6_decontaminate": op6.SQL,
    "op7_embedding_dedup": op7.SQL,
    "op9_warc": op9.SQL,
    "op10_url_filter": op10.SQL,
    "op11_filter_audit": op11.SQL,
    "op12_fill_in_middle": op12.SQL,
}
