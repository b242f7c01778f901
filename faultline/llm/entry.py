"""Queries of this subpackage for ``__spark_entry__.py``: one for each operator, over its whole table."""

from __future__ import annotations

from faultline.llm.bpe_codec import op4_bpe_codec
from faultline.llm.chat_format import OP2_SQL, op2_chat_format
from faultline.llm.decontamination import op7_decontamination
from faultline.llm.language_id import op8_language_id
from faultline.llm.near_dedup import OP5_SQL, op5_near_dedup
from faultline.llm.quality_classifier import op1_quality_classifier
from faultline.llm.quality_rules import op6_quality_rules
from faultline.llm.sharding import OP10_SQL, op10_sharding
from faultline.llm.token_counts import op3_token_counts
from faultline.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_chat_format, op3_token_counts, op4_bpe_codec, op5_near_dedup, op6_quality_rules, op7_decontamination, op8_language_id, op9_warc, op10_sharding)}

#: DuckDB SQL of those that SQL can express.
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op5_near_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op10_sharding": OP10_SQL}
