"""The queries of this package's operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.chat import OP3_SQL, op3_chat
from quire.llm.language import op4_language
from quire.llm.licences import OP9_SQL, op9_licences
from quire.llm.media import op1_media
from quire.llm.minhash import OP6_SQL, op6_minhash
from quire.llm.mixing import OP10_SQL, op10_mixing
from quire.llm.neighbours import op2_neighbours
from quire.llm.packing import op8_packing
from quire.llm.quality import op7_quality
from quire.llm.substring_dedup import OP5_SQL, op5_substring_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_neighbours": op2_neighbours,
    "op3_chat": op3_chat,
    "op4_language": op4_language,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash": op6_minhash,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_licences": op9_licences,
    "op10_mixing": op10_mixing,
}
ORACLES: dict[str, str] = {"op3_chat": OP3_SQL, "op5_substring_dedup": OP5_SQL, "op6_minhash": OP6_SQL, "op9_licences": OP9_SQL, "op10_mixing": OP10_SQL}
