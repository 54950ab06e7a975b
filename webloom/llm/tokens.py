"""Public tokenizers on the executors. The vocabulary file is read once on the
driver from a path the caller names, and broadcast: it is a few MB at most,
which is checked."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

from pyspark import Broadcast
from pyspark.sql import SparkSession

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20

# Fixed value: the pattern by which the byte-level vocabularies split text before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A text is encoded in blocks of so many characters, at least, if the encoder gives up on it whole.
BLOCK_CHARS = 20_000
#: The pattern never joins a sign of text to white space that follows it: blocks that begin there have the same tokens.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])[ \n]")


def broadcast_vocabulary(spark: SparkSession, path: str = DEFAULT_TOKENIZER) -> Broadcast:
    size = os.path.getsize(path)
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary may have {MAX_VOCABULARY_BYTES}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((os.path.basename(path), f.read()))


class ByteBpe:
    """Byte-level BPE: ids, and the byte length of every id."""

    def __init__(self, ranks_file: bytes) -> None:
        import numpy as np
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self._encoding = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.byte_lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for piece, rank in ranks.items():
            self.byte_lengths[rank] = len(piece)

    def encode(self, text: str) -> list[int]:
        try:
            return self._encoding.encode_ordinary(text)
        except UnicodeEncodeError:
            return self.encode(text.encode("utf-8", "replace").decode("utf-8"))
        except Exception:
            cuts = [0]
            for m in _CUT.finditer(text):
                if m.start() - cuts[-1] >= BLOCK_CHARS:
                    cuts.append(m.start())
            if len(cuts) == 1:
                raise
            return [t for a, b in zip(cuts, [*cuts[1:], len(text)]) for t in self.encode(text[a:b])]

    def count(self, text: str) -> int:
        return len(self.encode(text))


class JsonTokenizer:
    def __init__(self, data: bytes) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        self._tokenizer.encode_special_tokens = True

    def count(self, text: str) -> int:
        return len(self._tokenizer.encode(text, add_special_tokens=False).ids)


class PieceTokenizer:
    def __init__(self, data: bytes) -> None:
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_proto=data)

    def count(self, text: str) -> int:
        return len(self._processor.encode(text, num_threads=1))


@lru_cache(maxsize=4)
def _built(name: str, data: bytes):
    kind = name.rpartition(".")[2]
    return {"tiktoken": ByteBpe, "json": JsonTokenizer, "model": PieceTokenizer}[kind](data)


def tokenizer(vocabulary: Broadcast):
    """The tokenizer of a broadcast vocabulary, built once per Python worker."""
    return _built(*vocabulary.value)
