"""Parameters of the pipelines."""

from __future__ import annotations

from dataclasses import dataclass

# The parameters every comparison holds constant.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
CHARS_PER_TOKEN = 4
EMBEDDING_DIMENSION = 384
TOP_K = 5
ANN_LISTS = 100
ANSWER_MAX_TOKENS = 1024
ANSWER_TEMPERATURE = 0.1
ANSWER_MODEL = "llama-3.3-70b-versatile"

SYSTEM_PROMPT = "Use only the numbered sources below to answer, and name the sources that an answer rests on."
# Prompt tokens of one call of a responder, counted as four characters each.
MAX_CALL_TOKENS = 64_000

# Largest query side, in bytes of vectors, that is shipped to every task. Bigger
# batches are blocked and shuffled instead (see operators/topk.py).
MAX_SHIPPED_BYTES = 32 * 1024 * 1024
# Largest number of small rows (ids, winners, offsets) marked for broadcast.
MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """Sizes are in tokens, counted as four characters each."""

    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    embedding_dimension: int = EMBEDDING_DIMENSION
    top_k: int = TOP_K
    ann_lists: int = ANN_LISTS
    answer_max_tokens: int = ANSWER_MAX_TOKENS
    answer_temperature: float = ANSWER_TEMPERATURE
    answer_model: str = ANSWER_MODEL
    system_prompt: str = SYSTEM_PROMPT
    call_tokens: int = MAX_CALL_TOKENS

    def __post_init__(self) -> None:
        if self.chunk_overlap < 0 or self.chunk_size <= 0:
            raise ValueError("chunk_size must be positive and chunk_overlap not negative")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")
        if self.call_tokens <= 0:
            raise ValueError("call_tokens must be positive")
        if self.top_k <= 0 or self.ann_lists <= 0 or self.embedding_dimension <= 0:
            raise ValueError("top_k, ann_lists and embedding_dimension must be positive")

    @property
    def window_chars(self) -> int:
        return CHARS_PER_TOKEN * self.chunk_size

    @property
    def overlap_chars(self) -> int:
        return CHARS_PER_TOKEN * self.chunk_overlap
