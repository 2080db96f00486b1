"""The queries opN_<name> and the SQL for those that SQL can state."""

from __future__ import annotations

from .decontaminate import op5_decontaminate
from .langid import op10_langid
from .mixing import OP9_SQL, op9_mixing
from .neighbours import OP8_SQL, op8_neighbours
from .pii import op4_pii
from .quality import op1_quality
from .secrets import op3_secrets
from .simhash import op2_simhash
from .suffixes import op6_suffixes
from .toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_quality, op2_simhash, op3_secrets, op4_pii, op5_decontaminate, op6_suffixes, op7_toxicity, op8_neighbours, op9_mixing, op10_langid)}
ORACLE_SQL: dict[str, str] = {"op8_neighbours": OP8_SQL, "op9_mixing": OP9_SQL}
