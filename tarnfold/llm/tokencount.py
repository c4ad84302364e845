"""Token counts of whole texts with overlap resynchronisation for huge ones (operator 3).

Texts up to ``chunk`` bytes are encoded whole. A longer one is encoded in overlapping chunks with byte offsets. Two chunks
are spliced at a boundary inside their overlap which both have and which is proven stable: it stands before a space that
follows a non-space, and the vocabulary, inspected when it is loaded, has no piece with a space mark after another
character, so no merge reaches across it in any context. If an overlap has no such boundary it is widened, and once it is as
wide as the chunk the chunk grows; at worst the text is encoded whole. Counts equal those of whole encoding.

Null and empty texts have 0 bytes and 0 tokens. Each row keeps its own row, repeated rows too; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import once, table

MARK = "▁"
SPACES = (b" ", MARK.encode())


class PieceCounter:
    """Counts tokens with a sentencepiece model; ``chunk`` and ``overlap`` in bytes."""

    def __init__(self, path: str, chunk: int = 1 << 15, overlap: int = 1 << 10):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)

    def counts(self, texts: list[bytes]) -> list[int]:
        short, out = [i for i, t in enumerate(texts) if len(t) <= self.chunk or not self.stable], {}
        for k in range(0, len(short), 200):
            own = short[k:k + 200]
            out.update(zip(own, map(len, self.model.encode([texts[i].decode() for i in own], num_threads=1))))
        return [out[i] if i in out else self.long_count(t) for i, t in enumerate(texts)]

    def _begins(self, text: bytes, a: int, b: int) -> np.ndarray:
        proto = self.model.encode(text[a:b].decode(), return_type="proto")
        return a + np.array([p.begin for p in proto.pieces], np.int64)

    @staticmethod
    def _floor(text: bytes, at: int) -> int:
        """The start of the character at ``at``."""
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, len(text))

    def long_count(self, text: bytes) -> int:
        size, total, a, done = self.chunk, 0, 0, 0
        b = self._floor(text, size)
        begins, overlap = self._begins(text, a, b), self.overlap
        while b < len(text):
            c = self._floor(text, max(a, b - overlap))
            end = self._floor(text, c + max(size, 2 * (b - c)))
            after = self._begins(text, c, end) if c > a else begins[:0]
            common = [int(p) for p in np.intersect1d(begins, after) if max(c, done) < p < b and text[p:p + 1] == SPACES[0] and not text[:p].endswith(SPACES)] \
                if len(after) else []
            if common:
                total += int(((begins >= done) & (begins < common[0])).sum())
                a, b, begins, done, overlap = c, end, after, common[0], self.overlap
            elif c > a:
                overlap *= 2
            else:
                b = self._floor(text, a + 2 * (b - a))
                begins = self._begins(text, a, b)
        return total + int((begins >= done).sum())


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``path`` is read on the executors."""
    def run(batches):
        counter = once(f"pieces {path}", lambda: PieceCounter(path))
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(counter.counts(texts), pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES, ORACLES = {"op3_token_counts": op3_token_counts}, {}
