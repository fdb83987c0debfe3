"""Every registered query of the text operators: against its SQL, or by its columns."""

from __future__ import annotations

import pytest
from llm_tables import FOLDER
from oracle import connect, differences

from scrubline.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_nbsvm_quality": ["doc_id", "held_out", "score", "predicted"],
    "op3_simhash_groups": ["doc_id", "fingerprint", "component_id"],
    "op4_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op6_pii_spans": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op7_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op8_maxent_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op11_spelling_variants": ["word", "form", "root", "n", "n_near", "form_n"],
    "op12_main_text": ["page_id", "url", "text", "n_chars"],
    "op13_conversation_repair": [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
    ],
    "op9_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
}


#: Queries whose rows are not documents; their tests are beside the operators'.
OTHER_ROWS = ("op9_packing", "op11_spelling_variants", "op12_main_text", "op13_conversation_repair")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert set(COLUMNS.get(name, ())) <= set(frame.columns)
    if name in ORACLES:
        assert differences(frame, connect(FOLDER), ORACLES[name]) is None
    elif name not in OTHER_ROWS:
        docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
        ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
        assert ids(frame) == ids(docs)
