"""Token counts of whole texts under a public tokenizer whose files are installed beside the library."""

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in pieces of at most this length, cut where the pattern itself ends a match, so that the
#: tokens are those of the whole. Only a longer run of one kind of character has no such place and is cut inside, which
#: bounds the encoder's time (it is quadratic in such a run).
LONGEST_RUN = 50_000
#: Between two kinds of character a match ends, but for a blank before a word and an apostrophe before a letter.
BREAK = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"


@lru_cache(maxsize=2)
def encoder(folder: str = TOKENIZERS) -> Callable[[str], list[int]]:
    """One encoder for each Python worker."""
    import regex
    import tiktoken

    with open(os.path.join(folder, VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding("tickloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    last_break = regex.compile(f"(?r)(?:{BREAK})")

    def run(text: str) -> list[int]:
        tokens: list[int] = []
        at = 0
        while len(text) - at > LONGEST_RUN:
            found = last_break.search(text, at + 1, at + LONGEST_RUN + 1)
            end = found.start() if found else at + LONGEST_RUN
            tokens += encode(text[at:end])
            at = end
        return tokens + encode(text[at:])

    return run


def counted(folder: str = TOKENIZERS) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches whose last column is the text to batches in which its token count stands; a null text has 0 tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return run
