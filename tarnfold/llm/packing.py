"""Best-two-fit packing of tokenized documents (operator 5).

Each document becomes its token ids and an end id; one longer than a sequence is cut into full pieces and a rest. Pieces
are dealt to groups at random, each group is packed by best-two-fit: a sequence is filled greedily with the largest pieces
that fit, then its smallest piece goes back if two unpacked pieces together fit the space so made more tightly. A group
works on how many pieces it has of each length, so its cost is a few bit operations a piece. Only piece lengths and
checksums are shuffled, no ids; the number of groups follows the number of pieces.

A null text is empty and gives one piece of one end id. Repeated rows are packed each; extra columns are ignored.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import keep, once, table

#: Pieces of a packing group; a group ends with one or two sequences that are not full.
GROUP = 4000
#: Pieces of words whose ids a worker remembers; as many older ones are kept that come back when they are met again.
CACHE = 400_000
#: Bytes of texts that are looked at together; a longer text is looked at alone.
TOGETHER = 1 << 22
#: Kinds of bytes: white space, letters, first bytes of Latin letters, punctuation that parts from letters and digits for certain, digits, others, and those others whose
#: case is left alone.
SPACE, LETTER, LATIN, MARK, DIGIT, OTHER, AS_IS = range(7)
BLANK = b" \t\n\v\f\r"


def _kinds() -> bytes:
    kind = bytearray([OTHER] * 128 + [AS_IS] * 128)
    for of, found in ((SPACE, BLANK), (LETTER, string.ascii_letters.encode()), (LATIN, range(0xC3, 0xC9)), (MARK, string.punctuation.encode()), (DIGIT, string.digits.encode()),
                      (OTHER, b"'"), (AS_IS, b"|")):
        for byte in found:
            kind[byte] = of
    return bytes(kind)


KIND, LOWER = _kinds(), bytes(range(256)).lower()


def cut_words(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of the first piece of each text and of the end, all pieces) of texts that lie one after another; white space is left out."""
    kind = np.frombuffer(bytearray(data.translate(KIND)), np.uint8)
    # letters of two bytes, U+00C0 to U+023F but for two signs and for U+0130, whose lower case is two characters
    at = np.flatnonzero(kind[:-1] == LATIN)
    raw = np.frombuffer(data, np.uint8)
    two = raw[at].astype(np.uint16) << 8 | raw[at + 1]
    kind[at] = kind[at + 1] = np.where((two == 0xC397) | (two == 0xC3B7) | (two == 0xC4B0), AS_IS, LETTER)
    other, space = kind >= OTHER, kind == SPACE
    begins = np.ones(len(kind) + 1, bool)
    begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    begins[1:-1] &= ~(other[1:] | other[:-1])
    begins[1:-1] |= space[1:] | space[:-1]
    begins[offsets] = True
    place = np.flatnonzero(begins[:-1] & ~space)
    ends = np.cumsum(np.append(0, np.flatnonzero(begins[1:] & ~space) + 1 - place))
    low, odd = bytearray(data.translate(LOWER, BLANK)), np.flatnonzero(kind == AS_IS)
    if len(odd):
        own = np.unique(np.searchsorted(place, odd, "right") - 1)
        for at, a, b in zip(place[own].tolist(), ends[own].tolist(), ends[own + 1].tolist()):
            low[a:b] = data[at:at + b - a]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(low)])
    return np.searchsorted(place, offsets), pieces


def _parts(column: pa.Array, some=slice(None)) -> tuple[list[int], bytes]:
    """(where values begin, and the end; the bytes of all) of a large binary column; only ``some`` of the places."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return ends[some].tolist(), data.to_pybytes() if data else b""


class WordEncoder:
    """Token ids of a text as little-endian unsigned 32-bit numbers.

    White space always parts tokens in this vocabulary and leaves none, and its pattern parts letters, digits and punctuation. So texts are cut at white space,
    around digits and between letters and ASCII punctuation, all at once by kinds of bytes, and each distinct piece is encoded once in a while. No cut is made
    beside an apostrophe (the pattern knows some endings), a bar (special strings hold one), a control character or a character that is neither ASCII nor a Latin letter;
    pieces with a bar or such a character keep their case, as normal forms and special strings depend on it. Pieces of letters only
    are encoded many at a time, without the vocabulary's normalizer and pattern, which leave such words as they are: each gives ids of which just the last ends a word.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.model, self.held, self.older = Tokenizer.from_file(path), {}, {}
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(max(self.model.get_vocab().values()) + 1, bool)
        for token, number in self.model.get_vocab().items():
            self.ends[number] = token.endswith("</w>")

    @staticmethod
    def _plain(word: bytes) -> bool:
        """Letters only, which stay letters in the vocabulary's normal form: ASCII, or Latin ones below U+0250 but for U+0130."""
        if word.isascii():
            return word.isalpha()
        text = word.decode()
        return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        plain, odd = [], []
        for w in words:
            (plain if self._plain(w) else odd).append(w)
        out = {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(odd, self.model.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False))} if odd else {}
        for k in range(0, len(plain), 1000):
            some = plain[k:k + 1000]
            ids = np.array(self.words.encode_batch_fast([b" ".join(some).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            cuts, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            out.update(zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts))))
        return out

    def learn(self, words: list[bytes]) -> None:
        if len(self.held) > CACHE:
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        new = [w for w in words if w not in held]
        held.update((w, older[w]) for w in new if w in older)
        held.update(self._encode([w for w in new if w not in older]))

    def _ids(self, texts: list[bytes]):
        offsets = np.cumsum([0, *map(len, texts)])
        first, pieces = cut_words(b"".join(texts), offsets)
        pieces = pieces.dictionary_encode()
        ends, data = _parts(pieces.dictionary)
        words = [data[a:b] for a, b in zip(ends, ends[1:])]
        self.learn(words)
        ends, data = _parts(pa.array(map(self.held.__getitem__, words), pa.large_binary()).take(pieces.indices), first)
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def ids(self, texts: list[bytes]):
        """Ids of each text, in turn."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > TOGETHER:
                yield from self._ids(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        if some:
            yield from self._ids(some)


def piece_rows(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = once(f"words {path}", lambda: WordEncoder(path))
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            row, piece, length, crc = [], [], [], []
            for i, ids in enumerate(encoder.ids(texts)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    row.append(i), piece.append(k), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array([k * size for k in piece], pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Sequences as lists of lengths. Each length is from 1 to ``size``."""
    count = np.bincount(lengths, minlength=size + 1).tolist()
    have, back = 0, 0  # bit L of have, and bit size - L of back: a piece of length L is unpacked
    for n, c in enumerate(count):
        if c:
            have |= 1 << n
            back |= 1 << (size - n)

    def take(n):
        nonlocal have, back
        count[n] -= 1
        if not count[n]:
            have ^= 1 << n
            back ^= 1 << (size - n)

    def give(n):
        nonlocal have, back
        if not count[n]:
            have |= 1 << n
            back |= 1 << (size - n)
        count[n] += 1

    def two(total):
        """Two unpacked lengths of that sum."""
        both = have & (back >> (size - total))
        while both:
            a = both.bit_length() - 1
            if 2 * a != total or count[a] > 1:
                return a, total - a
            both ^= 1 << a
        return None

    out = []
    while have:
        gap, own = size, []
        while fits := have & ((1 << (gap + 1)) - 1):
            own.append(n := fits.bit_length() - 1)
            take(n)
            gap -= n
        if gap and len(own) > 1:
            least = own[-1]
            for total in range(gap + least, least, -1):
                if pair := two(total):
                    own.pop()
                    give(least)
                    for n in pair:
                        take(n)
                        own.append(n)
                    break
        out.append(own)
    return out


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = keep(piece_rows(docs, path, size, end_id, id_col, text_col))
    groups = -(-pieces.count() // GROUP) or 1
    # dealt by place in the kept rows, so that repeated rows go to all groups
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "ascending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = rows["length"].to_numpy()
        free = [[] for _ in range(size + 1)]
        for i in range(len(length) - 1, -1, -1):
            free[length[i]].append(i)
        sequence, offset, group = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), rows["group"][0].as_py() << 32
        for k, own in enumerate(best_two_fit(length, size)):
            at = 0
            for n in own:
                i = free[n].pop()
                sequence[i], offset[i] = group + k, at
                at += n
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("group").applyInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def op5_best_two_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES, ORACLES = {"op5_best_two_fit": op5_best_two_fit}, {}
