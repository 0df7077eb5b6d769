"""The operators' queries: opN_<name>(spark, sf_dir), and SQL for those that SQL can express."""

from .embeddup import OP10_SQL, op10_embedding_neardup
from .linededup import OP9_SQL, op9_line_dedup
from .neardup import OP1_SQL, op1_minhash_neardup
from .packing import op2_best_fit_packing
from .quality import op4_quality_rules
from .sampling import op8_sentencepiece_sampling
from .secrets import op5_secret_scan
from .sharding import op7_sharding
from .tokens import op6_token_binary
from .toxicity import op3_toxicity

QUERIES = {
    "op8_sentencepiece_sampling": op8_sentencepiece_sampling,
    "op10_embedding_neardup": op10_embedding_neardup,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op3_toxicity": op3_toxicity,
    "op1_minhash_neardup": op1_minhash_neardup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op6_token_binary": op6_token_binary,
    "op7_sharding": op7_sharding,
    "op9_line_dedup": op9_line_dedup,
}
ORACLE_SQL = {"op10_embedding_neardup": OP10_SQL, "op1_minhash_neardup": OP1_SQL, "op9_line_dedup": OP9_SQL}
