"""Operator 12. Aligns the tokens of two tokenizers over the same bytes, with packed bitsets.

Both tokenizers cut a text's bytes into tokens. One bitset a tokenizer marks the bytes at which its tokens end. Their AND holds the shared cuts: between two of them lies a group of A tokens over the
same bytes as a group of B tokens, and popcounts of the words before a cut (rank) give the tokens up to it. Their OR holds the common refinement: each of its pieces is the overlap of exactly one A token
with one B token, so the pieces are the links, and ranks at their starts name both tokens.

Both tokenizers end a token before any single space between two visible ASCII characters (this is checked on the vocabularies; where it does not hold, whole texts are taken), so a block of
texts is cut there and each distinct piece of a block is encoded and aligned once. Texts are lists of pieces then. How often an id pair is linked in the whole corpus is a sum over blocks: a block sends each of its pairs once with
its number of links; the sums come back to the blocks that have the pair, and meet their texts in tasks that hold one block (BLOCK bytes of text, or one longer text).

Texts that are null or empty, or whose tokens joined are not the text (B writes U+2581 as a space and its unknown token by name), have no tokens: zeros and the empty string. Special tokens inside texts are plain
text. Rows may repeat, whole or in their ids (null ids too): each is a document and counts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.llm.common import blocks, materialise, quoted, text_buffer

#: Bytes of text in a block, and pieces encoded by one call.
BLOCK = 4 << 20
CALL = 5_000

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
SPACE = 0x20


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: visible Latin-1 characters stand for themselves, the others take the code points from 256 on in turn."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}


class Vocabulary:
    """The bytes of each id, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        until = np.cumsum(size)
        return self.data[np.repeat(self.start[ids] - until + size, size) + np.arange(until[-1] if len(until) else 0)]


class ByteLevel:
    """A byte-level BPE from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters, named = _byte_letters(), self.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.vocabulary = Vocabulary(tokens)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = made.get("pre_tokenizer") or {}
        #: Words keep the space before them, and no merge passes over words.
        self.cuts_at_spaces = made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback. It puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.vocabulary = Vocabulary([bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)])
        #: Pieces hold spaces at their beginnings only, so no merge passes over one that follows another character; and spaces are kept as they are.
        self.cuts_at_spaces = not any("▁" in name.lstrip("▁") for name in names) and self.model.encode("a  b c ", out_type=str)[-1] == "▁"

    def __call__(self, pieces: list[str]) -> list[list[int]]:
        return self.model.encode([p[1:] for p in pieces], num_threads=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.in_pieces = self.a.cuts_at_spaces and self.b.cuts_at_spaces
        self.width = len(self.b.vocabulary.size)  # a pair of ids is a * width + b
        #: Ids in decimal digits, for both vocabularies.
        self.digits = pa.array([str(i).encode() for i in range(max(len(self.a.vocabulary.size), self.width))], pa.large_binary())


@functools.cache
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker, which its tasks share: threads of the tokenizers library are off, as Spark fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path_a, path_b)


class Bits:
    """A packed bitset with rank and select by popcounts."""

    def __init__(self, words: np.ndarray):
        self.words = words
        count = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(count) - count
        self.n = int(count.sum())

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[places] = True
        return cls(np.packbits(marks, bitorder="little").view(np.uint64))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set at places below each one."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        inside = np.append(self.words, np.uint64(0))[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return np.append(self.before, self.n)[word] + np.bitwise_count(inside)

    def select(self) -> np.ndarray:
        """The places of all set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def _encode(tokenizer: ByteLevel | Pieces, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, and the number of each one's."""
    ids, sizes = [], []
    for s in range(0, len(pieces), CALL):
        coded = tokenizer([p.decode("utf-8", "replace") for p in pieces.slice(s, CALL).to_pylist()])
        sizes.append(np.fromiter(map(len, coded), np.int64, len(coded)))
        ids.append(np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(sizes[-1].sum())))
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _same(vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each piece whether its tokens joined are its bytes."""
    joined = _firsts(vocabulary.size[ids])[_firsts(sizes)]
    length = np.diff(at)
    same = np.diff(joined) == length
    text = np.repeat(same, length)
    made = np.repeat(same, np.diff(joined))
    wrong = np.concatenate([[0], np.cumsum(data[text] != vocabulary.joined(ids)[made])])
    ends = _firsts(np.where(same, length, 0))
    return same & (wrong[ends[1:]] == wrong[ends[:-1]])


class Aligned:
    """Groups and links of some pieces, each of which starts with the space before it."""

    def __init__(self, aligner: Aligner, pieces: pa.Array):
        data, at = text_buffer(pieces)
        (a, n_a), (b, n_b) = _encode(aligner.a, pieces), _encode(aligner.b, pieces)
        self.fine = _same(aligner.a.vocabulary, a, n_a, data, at) & _same(aligner.b.vocabulary, b, n_b, data, at)
        a, b = a[np.repeat(self.fine, n_a)], b[np.repeat(self.fine, n_b)]
        self.n_a, self.n_b = np.where(self.fine, n_a, 0), np.where(self.fine, n_b, 0)
        until = _firsts(np.where(self.fine, np.diff(at), 0))  # bytes of the fine pieces, end to end
        size = int(until[-1])
        ends_a = Bits.at(np.cumsum(aligner.a.vocabulary.size[a]) - 1, size)
        ends_b = Bits.at(np.cumsum(aligner.b.vocabulary.size[b]) - 1, size)
        shared, either = ends_a & ends_b, ends_a | ends_b
        self.n_groups, self.n_links = np.diff(shared.rank(until)), np.diff(either.rank(until))
        # links: the refinement's pieces begin at 0 and after each end but the last
        begins = np.concatenate([[0], either.select()[:-1] + 1]) if size else np.zeros(0, np.int64)
        self.pairs = a[ends_a.rank(begins)].astype(np.int64) * aligner.width + b[ends_b.rank(begins)]
        self.text = self._groups(aligner, a, b, ends_a, ends_b, shared)

    def _groups(self, aligner: Aligner, a: np.ndarray, b: np.ndarray, ends_a: Bits, ends_b: Bits, shared: Bits) -> pa.Array:
        """For each piece `a1,a2|b1;a3|b2,b3;` with a separator after every id."""
        cuts = shared.select() + 1
        to_a, to_b = ends_a.rank(cuts), ends_b.rank(cuts)  # tokens up to the end of each group
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        ids, after = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), b",", "S1")
        ids[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = a
        ids[np.arange(len(b)) + np.repeat(to_a, in_b)] = b
        after[to_a + to_b - in_b - 1], after[to_a + to_b - 1] = b"|", b";"
        # a digit string and its separator in turn
        digits, offsets = text_buffer(aligner.digits.take(pa.array(ids)))
        size = np.diff(offsets)
        out = np.empty(len(digits) + len(ids), np.uint8)
        out[np.arange(len(digits)) + np.repeat(np.arange(len(ids)), size)] = digits
        out[offsets[1:] + np.arange(len(ids))] = after.view(np.uint8)
        bounds = _firsts(size + 1)[_firsts(self.n_a + self.n_b)]
        return pa.Array.from_buffers(pa.large_binary(), len(self.fine), [None, pa.py_buffer(bounds), pa.py_buffer(out)])


def cut(column: pa.Array, in_pieces: bool) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, each text with a space before it (empty ones have none), and len(column) + 1 offsets into them."""
    data, at = text_buffer(column)
    some = np.diff(at) > 0
    spaced = np.insert(data, at[:-1][some], SPACE)
    at = at + np.concatenate([[0], np.cumsum(some)])
    begins = np.zeros(len(spaced), bool)
    if in_pieces and len(spaced) > 2:
        begins[1:-1] = (spaced[1:-1] == SPACE) & _VISIBLE[spaced[:-2]] & _VISIBLE[spaced[2:]]
    begins[at[:-1][some]] = True
    starts = np.flatnonzero(begins)
    bounds = np.append(starts, len(spaced)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(spaced)]), np.searchsorted(starts, at)


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[firsts[1:]] - total[firsts[:-1]]


#: A block gives one row with its pairs and pieces, and one for each document.
_ROWS = "block string, pairs array<long>, links array<long>, piece_links binary, piece_ends binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pieces binary"
_NAMES = ["id", *(field.split()[0] for field in _ROWS.split(", "))]


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as bytes: all low bytes first, then all next ones, and so on, so that the compressor finds the zeros together."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _block(aligner: Aligner, name: str, ids: pa.Array, texts: pa.Array) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    words, firsts = cut(texts, aligner.in_pieces)
    coded = pc.dictionary_encode(words)
    place, done = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), Aligned(aligner, coded.dictionary)
    # texts with a piece whose tokens are not its bytes have no tokens
    fine = _sums(~done.fine[place], firsts) == 0
    place = place[np.repeat(fine, np.diff(firsts))]
    firsts = _firsts(np.where(fine, np.diff(firsts), 0))
    raw, ends = text_buffer(done.text.take(pa.array(place)))
    raw, ends = memoryview(np.ascontiguousarray(raw)), ends[firsts].tolist()
    digests = [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(ends[:-1], ends[1:])]
    used = np.bincount(place, minlength=len(done.fine))
    pairs, where = np.unique(done.pairs, return_inverse=True)
    links = np.zeros(len(pairs), np.int64)
    np.add.at(links, where, np.repeat(used, done.n_links))
    n, whole = len(texts), lambda values, kind: pa.array([values], pa.list_(kind))
    none = lambda k, kinds: [pa.nulls(k, t) for t in kinds]
    counts = [pa.int64()] * 4
    head = [pa.array([name]), whole(pairs, pa.int64()), whole(links, pa.int64()), pa.array([packed(where)], pa.binary()), pa.array([packed(np.cumsum(done.n_links))], pa.binary())]
    dictionary = pa.RecordBatch.from_arrays([*none(1, [ids.type]), *head, *none(1, [*counts, pa.string(), pa.binary()])], names=_NAMES)
    sums = [pa.array(_sums(x[place], firsts)) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)]
    bounds = firsts.tolist()
    listed = pa.array([packed(place[s:e]) for s, e in zip(bounds[:-1], bounds[1:])], pa.binary())
    documents = pa.RecordBatch.from_arrays([ids, pa.array([name] * n, pa.string()), *none(n, [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]), *sums, pa.array(digests, pa.string()), listed], names=_NAMES)
    return dictionary, documents


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of about `limit` bytes of text, over the bounds of Arrow batches."""
    held, size = [], 0
    for batch in batches:
        for part in blocks(batch, "text", limit):
            held.append(part)
            size += int(text_buffer(part.column("text"))[1][-1])
            if size >= limit:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def aligned_blocks(docs: DataFrame, id_column: str, paths: tuple[str, str], limit: int = BLOCK) -> DataFrame:
    slim = docs.select(quoted(id_column)[0].alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = aligner_of(*paths), TaskContext.get().partitionId()
        for i, block in enumerate(_gathered(batches, limit)):
            yield from _block(aligner, f"{task}/{i}", block.column("id"), block.column("text"))

    return slim.mapInArrow(run, StructType([slim.schema["id"], *StructType.fromDDL(_ROWS).fields]))


def pair_counts(dictionaries: DataFrame, width: int) -> DataFrame:
    """(pair, a, b, count, best) of all id pairs that are linked anywhere: the number of links, and whether no other pair of the B id has more. There is one B id a vocabulary entry, so their highest counts are a table of bounded size."""
    each = dictionaries.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    totals = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("count")).where("count > 0")
    totals = totals.select("pair", F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "count")
    most = totals.groupBy("b").agg(F.max("count").alias("most"))
    return totals.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(key: tuple, documents: pa.Table, scores: pa.Table) -> pa.Table:
    """Sums of the counts over each document's links: first over those of each piece of the block, then over the document's pieces."""
    documents = documents.combine_chunks()
    out = [documents.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not documents.num_rows:
        return pa.table([*out, pa.array([], pa.int64()), pa.array([], pa.int64()), documents.column("groups_sha256")], names=names)
    flat = lambda c: np.concatenate([np.zeros(0, np.int64), *(unpacked(x) for x in documents.column(c).drop_null().to_pylist())])
    links, ends = flat("piece_links"), flat("piece_ends")
    # pairs of pieces that no text uses have no count, nor a document that asks for it
    count, best = np.zeros(int(links.max(initial=-1)) + 1, np.int64), np.zeros(int(links.max(initial=-1)) + 1, np.int64)
    place = scores.column("place").to_numpy()
    count[place], best[place] = scores.column("count").to_numpy(), scores.column("best").to_numpy()
    of_piece = np.concatenate([[0], ends])
    best, count = _sums(best[links], of_piece), _sums(count[links], of_piece)
    # one document at a time: its list of pieces is all that is unpacked at once
    sums = [(int(best[p].sum()), int(count[p].sum())) for p in (unpacked(x) if x else np.zeros(0, np.int64) for x in documents.column("pieces").to_pylist())]
    whole = pa.table([*out, *(pa.array([x[i] for x in sums], pa.int64()) for i in (0, 1)), documents.column("groups_sha256")], names=names)
    return whole.filter(pc.is_valid(documents.column("n_a")))  # without the row of the block itself


def alignment(docs: DataFrame, id_column: str = "doc_id", paths: tuple[str, str] | None = None, limit: int = BLOCK) -> DataFrame:
    """One row per document: its id, tokens of A and B, groups, links, links that are their B id's most frequent ones, the sum of its links' corpus-wide counts, and a digest of its groups."""
    paths = paths or vocabularies()
    width = len(aligner_of(*paths).b.vocabulary.size)
    rows = materialise(aligned_blocks(docs, id_column, paths, limit), "op12-blocks")
    dictionaries = rows.where("pairs IS NOT NULL").select("block", "pairs", "links")
    scored = pair_counts(dictionaries, width)
    each = dictionaries.select("block", F.posexplode("pairs").alias("place", "pair"))
    back = each.join(scored, "pair").select(F.col("block").alias("of"), "place", "count", F.col("best").cast("long").alias("best"))
    own = rows.select("id", "block", "piece_links", "piece_ends", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pieces")
    schema = StructType([rows.schema["id"], *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    met = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored, schema)
    return met.select(F.col("id").alias(id_column), *(c for c in schema.names if c != "id"))


def groups_of(texts: list[str | None], paths: tuple[str, str] | None = None) -> list[str]:
    """The groups of some texts, written as in the digests: A ids, `|`, B ids, groups joined by `;`."""
    aligner = aligner_of(*(paths or vocabularies()))
    words, firsts = cut(pa.array(texts, pa.string()), aligner.in_pieces)
    done = Aligned(aligner, words)
    fine = _sums(~done.fine, firsts) == 0
    written = done.text.to_pylist()
    return [b"".join(written[s:e])[:-1].decode() if f else "" for s, e, f in zip(firsts[:-1].tolist(), firsts[1:].tolist(), fine.tolist())]
