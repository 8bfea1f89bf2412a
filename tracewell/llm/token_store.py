"""Operator 9. Token ids in a content-addressed store of chunks, with document recipes and Merkle manifests.

A rolling (gear) hash over the ids cuts each document's stream into chunks. A store keeps each distinct chunk once, by its BLAKE2b digest; a recipe lists a document's chunks in order,
its number of ids and its root (the digest of its chunks' digests); recipes are written in ascending doc_id order. The manifest is a Merkle tree over them: the root of a page of PAGE recipes (over each one's doc_id, number of ids and root, in order), of a file
(over its pages' roots) and of the store (over its files' roots), each with its numbers of documents and ids. Chunks hold 16-bit little-endian ids where the vocabulary fits, else 32-bit.

Reading back: each stored chunk is checked against its digest where it is read and gives its number of ids and CRC-32; the CRC of a document is combined from its chunks' (CRCs are linear), so chunk bytes
are never shuffled to documents. All roots of the manifest are computed again from the recipes before anything is returned, and each recipe's root and number of ids from its chunks; whatever is lost, doubled or changed raises ValueError. `documents` rebuilds the ids themselves.

Where the tokenizer allows it (a probe text tells), text is split at ASCII white space, which it drops and never joins tokens over, and where it always splits words, and each distinct piece of a block is encoded once by the tokenizers library; else whole texts are encoded. Null texts count as empty: the end id alone. Rows that share a
doc_id are ordered by their roots; equal rows are interchangeable. A null doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BLOCK_BYTES, GEAR, SPACES, blocks, materialise, mix64, scratch_dir, shuffle_partitions, text_buffer, word_spans

#: A cut where this many top bits are zero (256 ids a chunk on average); chunks of more than MAX_IDS are cut by length.
CUT_BITS, MAX_IDS = 8, 4096
END_ID = 1
#: Recipes that a page of the manifest covers, and pieces that a task remembers.
PAGE, REMEMBERED = 1024, 400_000
#: Encoded in whole and in pieces when an encoder is made: pieces are used if both agree.
PROBE = "It's  WORDS, Words\twords 12ab3 don't!! a-b_c (x)\n\nÉté “quoted” naïve ß 日本語 テキスト <|EndOfText|> e\u0301 ... ?! 'tis rock'n'roll | x|y a.b,c;d:e 3.14 $5 C++ #1"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes between which the tokenizer's pre-tokenizer always splits: ASCII letters, digits, other ASCII. No cut next to the rest (0): bytes of other characters, and ' and | (contractions, special tokens).
_KIND = np.full(256, 3, np.uint8)
_KIND[97:123], _KIND[48:58], _KIND[128:], _KIND[[39, 124]] = 1, 2, 0, 0


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words in lower case (those that hold | as they stand: special tokens match in their own case only), cut where the tokenizer splits them anyway, and len(offsets) offsets into them."""
    raw, data = data, _LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    kind = _KIND[data]
    barred = np.unique(np.searchsorted(starts, np.flatnonzero(data == 124), "right") - 1)
    if len(barred):
        length = ends[barred] - starts[barred]
        at = np.arange(length.sum()) + np.repeat(starts[barred] - np.cumsum(length) + length, length)
        data[at] = raw[at]
    inner = np.zeros(len(data), bool)
    inner[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    inner[ends[ends < len(data)]] = False
    inner[starts] = False
    solid = ~SPACES[data]
    inner &= solid
    cuts = np.flatnonzero(inner)
    inner[starts] = True
    firsts = firsts + np.searchsorted(cuts, offsets)
    begin = np.flatnonzero(inner[solid])  # places among the bytes of words
    at = np.append(begin, int(solid.sum())).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(data[solid])])
    return words, firsts


class Encoder:
    """Encodes blocks of texts, remembering pieces met before."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # every byte can end a word, so no end is lost to a token that the vocabulary lacks
        self.closed = all(f"{c}</w>" in vocabulary for c in ByteLevel.alphabet())
        # pieces met before, with the places and numbers of their ids in `flat`; the first is the end of a document
        self.known = pa.array([b""], pa.large_binary())
        self.flat, self.size = np.array([END_ID], self.dtype), np.ones(1, np.int32)
        self.in_pieces = True
        ids, _ = self(*text_buffer(pa.array([PROBE])))
        self.in_pieces = ids[:-1].tolist() == self.tokenizer.encode(PROBE, add_special_tokens=False).ids

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Pieces of letters are encoded many at a time and told apart by their last tokens; others one by one. Letters make one end a piece at least, so as many ends as pieces are one each."""
        out: list[bytes | None] = [None] * len(words)
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [i for i, (w, t) in enumerate(zip(words, texts)) if w.isalpha() or self.closed and t.isalpha()]
        groups = [plain[s : s + 500] for s in range(0, len(plain), 500)]
        coded = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in g]) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, coded):
            ids = np.array(e.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(group) and ends[-1] == len(ids):
                for i, a, b in zip(group, [0, *ends[:-1].tolist()], ends.tolist()):
                    out[i] = ids[a:b].tobytes()
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.dtype).tobytes()
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END_ID at its end, and len(offsets) offsets into them."""
        if not self.in_pieces:
            raw, at = data.tobytes(), offsets.tolist()
            coded = self.tokenizer.encode_batch_fast([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], add_special_tokens=False)
            ids = np.array([i for e in coded for i in (*e.ids, END_ID)], self.dtype)
            return ids, np.cumsum([0, *(len(e.ids) + 1 for e in coded)])
        words, firsts = pieces(data, offsets)
        listed = words.dictionary_encode()
        found = pc.index_in(listed.dictionary, value_set=self.known)
        missing = found.is_null()
        new = listed.dictionary.filter(missing)
        coded = self._encode(new.to_pylist())
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(coded), self.dtype)])
        size = np.concatenate([self.size, np.fromiter(map(len, coded), np.int32, len(coded)) // self.dtype.itemsize])
        place = found.fill_null(0).to_numpy(zero_copy_only=False).copy()
        place[missing.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(new))
        place = place[listed.indices.to_numpy()]
        if len(self.known) < REMEMBERED:
            self.known, self.flat, self.size = pa.concat_arrays([self.known, new]), flat, size
        at = np.cumsum(size, dtype=np.int32) - size
        sequence = np.insert(place, firsts[1:], 0)
        length = size[sequence]
        until = np.cumsum(length, dtype=np.int64)
        ids = flat[np.repeat(at[sequence] - until + length, length) + np.arange(length.sum())]
        bounds = np.concatenate([[0], until])
        return ids, bounds[np.concatenate([[0], firsts[1:] + np.arange(1, len(firsts))])]


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for each Python worker, which its tasks share: threads of the tokenizers library are off, as Spark fills the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


#: The gear hash's word for each id (ids beyond share them).
_GEAR = mix64(np.arange(1 << 16, dtype=np.uint64) + GEAR[0]).astype(np.uint32)


def cut(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends of the chunks: where the gear hash over the last eight ids (a shift of four bits each) says so, at the end of a document, and after MAX_IDS."""
    rolling = _GEAR[ids & 0xFFFF]
    for j in (1, 2, 4):  # windows of 2, 4, 8 ids
        before = rolling[:-j].copy()
        rolling[j:] += before << np.uint32(4 * j)
    at = np.union1d(np.flatnonzero(rolling >> np.uint32(32 - CUT_BITS) == 0) + 1, offsets[1:])
    length = np.diff(at, prepend=0)
    if len(length) and length.max() > MAX_IDS:
        more = [np.arange(e - n + MAX_IDS, e, MAX_IDS) for e, n in zip(at[length > MAX_IDS], length[length > MAX_IDS])]
        at = np.union1d(at, np.concatenate(more))
    return at


def _digest(chunk: bytes | memoryview) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


_ROWS = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary()))])


def _encoded(path: str):
    """Rows of two kinds: chunks (key: digest) and recipes (key: the place of the document in the scan)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, done = encoder_of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for block in blocks(batch, "text", 3 * BLOCK_BYTES):
                ids, offsets = encoder(*text_buffer(block.column("text")))
                ends = cut(ids, offsets)
                raw, width = ids.tobytes(), encoder.dtype.itemsize
                chunks = [raw[a * width : b * width] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                digests = [_digest(c) for c in chunks]
                first = np.concatenate([[0], np.searchsorted(ends, offsets[1:]) + 1])
                roots = [_digest(b"".join(digests[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                n, once = block.num_rows, dict(zip(digests, chunks))
                none = lambda t, k: pa.nulls(k, t)
                m = len(once)
                names = pa.array([b"%d/%d" % (task, done + i) for i in range(n)], pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(digests, pa.binary()))
                done += n
                yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * n), names, none(pa.binary(), n), block.column("doc_id"), pa.array(np.diff(offsets)), pa.array(roots, pa.binary()), listed], schema=_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * m, pa.string()), pa.array(list(once), pa.binary()), pa.array(list(once.values()), pa.binary()), none(pa.int64(), m), none(pa.int64(), m), none(pa.binary(), m), none(pa.list_(pa.binary()), m)], schema=_ROWS)

    return run


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None) -> dict[str, DataFrame]:
    """Encode docs and write `objects` (chunks, and recipes as they come), `recipes` in order, and `manifest` below path. Returns chunks, recipes and manifest, as read back.

    Chunks and recipes leave the encoder together, so that nothing is encoded twice or kept in between."""
    spark, tokenizer = docs.sparkSession, tokenizer or vocabulary()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    types = "kind string, key binary, ids binary, doc_id long, n_tokens long, root binary, digests array<binary>"
    rows = slim.mapInArrow(_encoded(tokenizer), types)
    rows.groupBy("kind", "key").agg(*(F.first(c).alias(c) for c in ("ids", "doc_id", "n_tokens", "root", "digests"))).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/objects")
    objects = spark.read.schema(types).parquet(f"{path}/objects")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]
    ordered = objects.where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "digests").repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    # places are those of the sorted rows, from 1: a retried task sorts the same rows in the same way
    numbered = ordered.withColumns({"file": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    numbered.write.parquet(f"{path}/recipes")
    recipes = spark.read.schema(numbered.schema).parquet(f"{path}/recipes")
    merkle(recipes).withColumn("id_bytes", F.lit(_width(tokenizer))).write.parquet(f"{path}/manifest")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    return {"recipes": recipes, "chunks": objects.where("kind = 'chunk'").select(F.col("key").alias("digest"), "ids"), "manifest": manifest}


def open_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The chunks, recipes and manifest of a store written before."""
    chunks = spark.read.schema("key binary, ids binary, kind string").parquet(f"{path}/objects").where("kind = 'chunk'").select(F.col("key").alias("digest"), "ids")
    return {"recipes": spark.read.parquet(f"{path}/recipes"), "chunks": chunks, "manifest": spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")}


def _width(tokenizer: str) -> int:
    return encoder_of(tokenizer).dtype.itemsize


_MANIFEST = "level string, file int, page long, n_documents long, n_tokens long, root string, id_bytes int"


def _above(nodes: DataFrame, level: str, by: list[str], order: str) -> DataFrame:
    """The nodes over groups of nodes: each root is the digest of the roots below, in order."""
    below = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "root"))), lambda x: x["root"]), "")
    key = [F.col(c) if c in by else F.lit(None).cast(t).alias(c) for c, t in (("file", "int"), ("page", "long"))]
    return nodes.groupBy(*by).agg(F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(below, 256).alias("root")).select(F.lit(level).alias("level"), *key, "n_documents", "n_tokens", "root")


def merkle(recipes: DataFrame) -> DataFrame:
    """(level, file, page, n_documents, n_tokens, root) of every page of recipes, every file and the store. A group has at most PAGE recipes, a file's pages, or the files."""
    leaf = F.sha2(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), F.hex("root")), 256)
    leaves = recipes.select("file", F.floor((F.col("place") - 1) / PAGE).alias("page"), "place", F.lit(1).cast("long").alias("n_documents"), "n_tokens", leaf.alias("root"))
    pages = materialise(_above(leaves, "page", ["file", "page"], "place"), "op9-pages")
    files = _above(pages, "file", ["file"], "page")
    return pages.union(files).union(_above(files, "store", [], "file").where("n_documents is not null"))


def verify_manifest(store: dict[str, DataFrame]) -> None:
    """Raise ValueError unless the manifest is that of the recipes: any recipe lost, doubled, moved or changed shows in the roots above it."""
    key = ["level", F.coalesce("file", F.lit(-1)).alias("file"), F.coalesce("page", F.lit(-1)).alias("page"), "n_documents", "n_tokens", "root"]
    said, found = store["manifest"].select(*key), merkle(store["recipes"]).select(*key)
    wrong = said.exceptAll(found).union(found.exceptAll(said)).orderBy("level", "file", "page").take(3)
    if wrong:
        raise ValueError(f"the manifest does not match the recipes: {[tuple(r) for r in wrong]}")


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


def combined_crc(crc: np.ndarray, after: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of pieces (firsts: where the runs begin) from the pieces' CRCs and the numbers of bytes that follow each in its run."""
    shift = np.full(len(crc), 1 << 31, np.uint64)  # x^0
    power = np.full(1, 1 << 23, np.uint64)  # x^8: one byte
    left = after.astype(np.uint64)
    while left.any():
        odd = np.flatnonzero(left & np.uint64(1))
        shift[odd] = _times(shift[odd], np.repeat(power, len(odd)))
        power, left = _times(power, power), left >> np.uint64(1)
    return np.bitwise_xor.reduceat(_times(shift, crc.astype(np.uint64)), firsts) if len(crc) else np.zeros(0, np.uint64)


def _checked_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("ids"))
            raw, at = memoryview(data), offsets.tolist()
            for digest, a, b in zip(batch.column("digest").to_pylist(), at[:-1], at[1:]):
                if _digest(raw[a:b]) != digest:
                    raise ValueError(f"chunk {digest.hex()} does not match its digest")
            # ids are widened a batch at a time
            wide, places = memoryview(data.view(f"<u{width}").astype("<u4").tobytes()), (offsets * 4 // width).tolist()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip(places[:-1], places[1:])]
            yield pa.record_batch([batch.column("digest"), pa.array(crcs, pa.int64()), pa.array(np.diff(offsets) // width)], ["digest", "crc", "n"])

    return run


def _assembled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        sizes = df["pieces"].map(len).to_numpy()
        firsts = np.cumsum(sizes) - sizes
        parts = [sorted((p["at"], p["digest"], -1 if p["crc"] is None else p["crc"], p["n"] or 0) for p in row) for row in df["pieces"]]
        for root, wanted, part in zip(df["root"], df["n_chunks"], parts):
            if len(part) != wanted or any(p[2] < 0 for p in part) or _digest(b"".join(bytes(p[1]) for p in part)) != bytes(root):
                raise ValueError(f"recipe {bytes(root).hex()} cannot be rebuilt")
        n = np.array([p[3] for part in parts for p in part], np.int64)
        total = np.add.reduceat(n, firsts) if len(n) else n
        if (total != df["n_tokens"].to_numpy()).any():
            raise ValueError("a document's number of ids differs from its recipe's")
        after = np.repeat(total + np.concatenate([[0], np.cumsum(total)[:-1]]), sizes) - np.cumsum(n)
        crc = combined_crc(np.array([p[2] for part in parts for p in part], np.int64), 4 * after, firsts)
        yield pd.DataFrame({"file": df["file"], "place": df["place"], "doc_id": df["doc_id"], "n_tokens": total, "ids_crc32": crc.astype(np.int64)})


def read_back(store: dict[str, DataFrame], width: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files, whose manifest is verified first."""
    verify_manifest(store)
    place = Window.partitionBy("file").orderBy("place")
    recipes = store["recipes"]
    before = F.sum("n_tokens").over(place.rowsBetween(Window.unboundedPreceding, -1))
    starts = recipes.withColumn("inside", F.coalesce(before, F.lit(0)))
    files = store["manifest"].where("level = 'file'").select("file", F.col("n_tokens").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = files.select("file", offset.alias("offset"))  # one row a file
    listed = starts.join(F.broadcast(offsets), "file").select("doc_id", "n_tokens", "root", F.size("digests").alias("n_chunks"), F.struct("file", "place", (F.col("offset") + F.col("inside")).alias("start")).alias("id"), F.posexplode("digests").alias("at", "digest"))
    pieces = store["chunks"].mapInArrow(_checked_chunks(width), "digest binary, crc long, n long")
    joined = listed.join(pieces, "digest", "left")  # a chunk that is not in the store leaves nulls, which are refused
    grouped = joined.groupBy("id").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.first("n_chunks").alias("n_chunks"), F.collect_list(F.struct("at", "digest", "crc", "n")).alias("pieces"))
    flat = grouped.select(F.col("id.start").alias("file"), F.col("id.place").alias("place"), "doc_id", "n_tokens", "root", "n_chunks", "pieces")
    return flat.mapInPandas(_assembled, "file long, place long, doc_id long, n_tokens long, ids_crc32 long").select("doc_id", F.col("file").alias("start"), "n_tokens", "ids_crc32")


def documents(store: dict[str, DataFrame], width: int) -> DataFrame:
    """(doc_id, root, ids): the id streams rebuilt from recipes and chunks."""
    listed = store["recipes"].withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "root", F.posexplode("digests").alias("at", "digest"))
    joined = listed.join(store["chunks"], "digest").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("root").alias("root"), F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            ids = [np.frombuffer(b"".join(bytes(p["ids"]) for p in row), f"<u{width}").astype(np.int64) for row in df["parts"]]
            yield pd.DataFrame({"doc_id": df["doc_id"], "root": df["root"], "ids": ids})

    return joined.select("doc_id", "root", "parts").mapInPandas(run, "doc_id long, root binary, ids array<long>")


def token_store(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs to a new store in the shared folder and read it back."""
    tokenizer = tokenizer or vocabulary()
    return read_back(write_store(docs, scratch_dir(docs.sparkSession, "op9-store"), tokenizer), _width(tokenizer))
